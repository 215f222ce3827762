"""End-to-end jobs: assemble, build features, train, score, report."""
