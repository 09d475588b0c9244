"""The pipeline's stages take effect, keep clean documents, and hand on the columns of documents."""

import duckdb
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402
from logtide.llm import queries as q  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = [(90_001, " ".join(f"z{i}" for i in range(80)), "en", "src1", 1), (90_002, " ".join(f"z{i}" for i in range(79)) + " extra", "en", "src1", 1), (90_003, "my mail is a.b@c.example.org and I am fine with it", "en", None, 1), (90_004, None, None, None, None)]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    planted.append((90_005, "before " + item.text + " after", "en", "src2", 1))
    df = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in cp.STAGES:
        before = df.count()
        df = stage(spark, df, sf_dir).cache()
        seen[name] = {r.doc_id: r for r in df.collect()}
        assert df.columns[:5] == COLUMNS and (name == cp.STAGES[-1][0] or df.columns == COLUMNS) and 0.7 * before < df.count() <= before
    assert {90_001, 90_002, 90_003, 90_004, 90_005} <= set(seen["toxicity"])
    assert 90_001 in seen["near_duplicates"] and 90_002 not in seen["near_duplicates"]
    assert 90_005 not in seen["decontamination"] and 90_001 in seen["decontamination"]
    r = seen["personal_data"][90_003]
    assert "a.b@c.example.org" not in r.text and r.n_chars == len(r.text) and seen["personal_data"][90_004].text is None
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in seen["mixing"].values()) and set(seen["mixing"]) == set(seen["personal_data"])


def test_run_is_its_stages(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        df = stage(spark, df, sf_dir)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


def test_rows_without_an_id_of_their_own(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    copy, other = " ".join(f"z{i}" for i in range(90)), " ".join(f"y{i}" for i in range(90))
    rows = [(None, copy, "en", "s", 1), (None, copy, "en", "s", 1), (50_000, copy, "en", "s", 1), (50_000, copy, "en", "s", 1), (50_000, other, "en", "s", 1), (None, f"a {item} b", "en", "s", 1), (50_001, f"c {item} d", "en", "s", 1), (50_001, "a clean text of its own", "en", "s", 1)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = cp.drop_near_duplicates(spark, df, sf_dir).collect()
    assert [(r.doc_id, r.text) for r in got if r.text in (copy, other)] in ([(50_000, copy), (50_000, other)], [(50_000, other), (50_000, copy)])
    got = [(r.doc_id, r.text) for r in cp.drop_leaks(spark, df, sf_dir).collect()]
    assert (50_001, rows[-1][1]) in got and not any(item in (t or "") for _, t in got) and got.count((None, copy)) == 2


def test_mix_of_repeated_ids(spark):
    from logtide.llm import mixing

    rows = [(i % 40, " ".join(["w"] * (1 + i % 23)), "ab"[i % 3 > 0]) for i in range(200)] + [(None, "n " * 5, "a")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.with_copies(df).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.text, r.source) for r in got) == sorted((d or -1, t, s) for d, t, s in rows)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 23 and {r.source_size for r in mine} == {sum(r.size for r in mine)}


def test_empty_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        df = stage(spark, df, sf_dir)
    assert df.count() == 0


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, sf_dir), c.sql(q.ORACLE_SQL[name])
    at = [list(want.columns).index(x) for x in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_names():
    assert [n.split("_")[0] for n in q.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_a_grown_driver_heap_is_collected(spark):
    from logtide.llm.common import Scratch

    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    whole = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    held = []
    while 2 * runtime.totalMemory() <= runtime.maxMemory():
        held.append(jvm.java.nio.ByteBuffer.allocate(64_000_000))
    before = whole()
    Scratch(spark, "test").save(spark.range(10), "rows")
    assert held and whole() > before
