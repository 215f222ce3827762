"""DataFrame -> DataFrame operators for station-day panels."""
