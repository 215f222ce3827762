"""The registered queries against their SQL, and the pipeline against plain stages."""

from types import SimpleNamespace

import public_tokenizers
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from skyledger.llm.decontam import without_contamination
from skyledger.llm.quality import judge
from skyledger.llm.queries import QUERIES, SQL
from tests.compare import compare, duck
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SimpleNamespace(run=QUERIES[name], sql=SQL[name]), FOLDER) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name.startswith("op11_"):
        queries = spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()
        assert [r["n"] for r in df.groupBy("query_id").agg(F.count("*").alias("n")).collect()] == [20] * len(queries)
        return
    key, table = ("page_id", "pages") if name.startswith("op2_") else ("doc_id", "documents")
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in df.select(key).collect()} == ids


def test_pipeline(spark, documents, corpus, tmp_path):
    from tokenizers import Tokenizer

    texts = dict(corpus)
    folder = str(tmp_path)
    documents.write.parquet(f"{folder}/documents.parquet")
    items = [(1, texts[70]), (2, " ".join(texts[4].split()[5:40])), (3, "never seen anywhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    good = {r.doc_id for r in judge(documents).filter("kept").collect()}
    for d in good:
        n, _, _, _, repeated = plain.counts(texts[d])
        assert n >= 50 and 100 * repeated <= 50 * n
    left = {d: texts[d] for d in good}
    left = {d: left[d] for d, (_, c) in plain.near_classes(left).items() if c == d}
    cut = plain.removed_words(left)
    left = {d: cut[d][2] if cut[d][1] else t for d, t in left.items()}
    left = {d: left[d] for d, r in plain.contamination(left, items).items() if not r[3]}
    assert 10 < len(left) < len(good) < len(corpus)

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == documents.schema.names, name
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in left.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = {}
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = [*tokenizer.encode(left[r.doc_id], add_special_tokens=False).ids, 1]
        assert plain.checksum(ids[r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids)
        assert found.get(r.doc_id, 0) == r.start
        found[r.doc_id] = r.start + r.length
    assert found == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns_and_rows_without_an_id(spark, documents, corpus, tmp_path):
    """Columns with names of results come through as they are; a rejected id takes all its rows, no id is never rejected."""
    texts = dict(corpus)
    folder, long = str(tmp_path), "word " * 80
    extra = spark.createDataFrame(
        [(None, long, "en", "s", 400), (7000, long, "en", "s", 400), (7000, texts[94], "en", "s", len(texts[94]))], documents.schema.simpleString()[7:-1].replace(":", " "))
    names = ("n_words", "kept", "items", "spans", "n_hit", "contaminated", "n_removed", "factors", "component_id")
    docs = documents.unionByName(extra).withColumns({c: F.lit(f"mine {c}") for c in names})
    spark.createDataFrame([(1, texts[70])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [*documents.columns, *names], name
    rows = docs.collect()
    assert len(rows) > 10 and all(r[c] == f"mine {c}" for r in rows for c in names)
    assert [r.text for r in rows if r.doc_id is None] == [long] and not [r for r in rows if r.doc_id == 7000]


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontamination_keeps_clashing_columns(spark, remove):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"{text} more", 5, "a"), (2, "clean", 6, "b")], "doc_id long, text string, spans int, contaminated string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = without_contamination(docs, bench, remove=remove).collect()
    assert {r.doc_id: (r.spans, r.contaminated) for r in got} == ({2: (6, "b")} if remove == "documents" else {1: (5, "a"), 2: (6, "b")})
