"""Catalog queries, rules and functions on hand-worked fixtures, and every query against its SQL."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import blake3, content, expr
from cairn.operators import catalog, changes, rules
from cairn.operators.rules import InvalidRule, ScanRule
from cairn.plans.catalog_suite import QUERIES, SQL
from cairn.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
MINI = [("/a/1.txt", "cidA", 10, 6), ("/a/2.TXT", "cidA", 10, 6), ("/b/.gitignore", "cidB", 5, 7), ("/b/foo.", "cidC", 3, 4), ("/b/noext", "cidA", 10, 6), ("/img/p.png", "cidD", 100, 90), ("/img/q.png", "cidD", 100, 90)]


@pytest.fixture(scope="module")
def mini(spark):
    paths = spark.createDataFrame([(*r, 100) for r in MINI], "path string, cid string, original_size long, compressed_size long, modified long")
    dirs = spark.createDataFrame([("/a", 11), ("/b", 12), ("/img", 13), ("/empty", 14), ("/empty/deep", 15)], "path string, modified long")
    return paths, dirs


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_statistics(mini):
    paths, dirs = mini
    assert tuples(catalog.extension_stats(paths)) == [("png", 2, 2, 100.0, 200, 180, 20), ("txt", 2, 2, 100.0, 20, 12, 8), ("(no ext)", 2, 1, 50.0, 13, 10, 3), ("gitignore", 1, 0, 0.0, 5, 7, 0)]
    assert tuples(catalog.store_stats(paths, dirs))[0][:6] == (7, 5, 4, 5, 238, 209)
    assert tuples(catalog.duplicate_groups(catalog.index_of(paths))) == [("cidA", ["/a/1.txt", "/a/2.TXT", "/b/noext"]), ("cidD", ["/img/p.png", "/img/q.png"])]


def test_listing(mini):
    names = lambda p: [(r[0], r[3]) for r in tuples(catalog.list_dir(*mini, p))]
    assert names("/") == [("a", 0), ("b", 0), ("empty", 14), ("img", 0)] and names("/empty") == [("deep", 15)]
    assert [n for n, _ in names("/b")] == [".gitignore", "foo.", "noext"] and names("/a/") == names("/a")
    assert names("/a/1.txt") == names("/nope") == names("b") == []


def test_additive_index(mini, spark):
    paths, dirs = mini
    new = spark.createDataFrame([("/b/noext", "cidE", 1, 1, 1)], paths.schema)
    now, index = changes.merged(paths, new), changes.additive_index(catalog.index_of(paths), new)
    assert catalog.duplicates_of_cid(index, "cidA").count() == 3 and tuples(catalog.store_stats(now, dirs, index))[0][2:4] == (5, 5)
    assert catalog.duplicates_of_cid(catalog.index_of(now), "cidA").count() == 2 and tuples(catalog.store_stats(now, dirs))[0][2:4] == (5, 4)


ENTRIES = """.|d .git|d .git/HEAD|f .git.tar|f target|d target/debug|d target/debug/app|f app|d app/node_modules|d app/node_modules/react|d app/node_modules/react/index.js|f src.rs|f cache|f
x|d x/foo|d x/foo/.tar|f x/foo.tar|f y|d y/.git|d y/.git/HEAD|f y/.git.tar|d y/.git.tar/nested|f"""


def test_rules_on_a_tree(spark):
    rows = [("" if r == "." else r, {"d": "dir", "f": "file"}[k]) for r, k in (x.split("|") for x in ENTRIES.split())]
    used = [ScanRule(r"(^|/)\.git$", "archive"), ScanRule(r"(^|/)target$", "ignore"), ScanRule(r"(^|/)node_modules$", "ignore"), ScanRule(r"(^|/)cache$", "archive")]
    got = dict(tuples(rules.decided(spark.createDataFrame(rows, "rel string, kind string"), used).select("rel", "decision")))
    want = {".git": "archive", "y/.git": "archive", ".git.tar": "collision", "y/.git.tar": "collision", "target": "ignore", "app/node_modules": "ignore", "cache": "skip"}
    want |= dict.fromkeys(["", "app", "src.rs", "x", "x/foo", "x/foo/.tar", "x/foo.tar", "y"], "plain")
    assert got == want


def test_patterns(spark):
    for bad in ("[", "(?=x)", r"(a)\1", "(?<!x)", "(?U)a", "a*+"):
        with pytest.raises(InvalidRule, match="invalid scan rule"):
            rules.java_pattern(bad)
    one = lambda p, text: spark.range(1).select(F.lit(text).rlike(rules.java_pattern(p))).first()[0]
    assert not one("a$", "a\n") and one("a$", "xa") and one(r"[$]", "$") and one(r"\w", "é")
    with pytest.raises(InvalidRule):
        rules.check_custom({"label": "x", "pattern": " ", "action": "ignore"})
    assert [r.action for r in rules.from_flags(git=True, node=True, ignore=["i"], archive=["a"])] == ["archive", "ignore", "ignore", "archive"]


def test_identity(spark):
    want = {b"": "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", b"abc": "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", b"hello world": "d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"}
    rng = random.Random(1)
    sizes = [1, 63, 64, 65, 1023, 1024, 1025, 2048, 3073, 5000, 7168, 31745, 102400]
    data = [*want, *(rng.randbytes(n) for n in sizes)]
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    got = blake3.digests(data)
    assert [g.hex() for g in got[:3]] == list(want.values()) and got == [bytes(jvm.hash(d)) for d in data]
    kept, blake3.SEGMENT = blake3.SEGMENT, 4096  # a long content is hashed segment by segment
    try:
        for d, g in zip(data, got):
            h = blake3.Hasher()
            for k in range(0, len(d), 700):
                h.update(d[k : k + 700])
            assert h.digest() == g
    finally:
        blake3.SEGMENT = kept
    cid = content.compute_cid(b"hello world")
    assert content.cid_text(cid) == "bafkr4igxjga67jykbseaxdmmdgc5a5o3zp3htom2l6mrjznk7fvyggu6eq" and content.cid_parse(content.cid_text(cid)) == cid
    assert spark.range(1).select(expr.content_cid(F.lit("hello"))).first()[0] == "bafkreibm6jg3ux5qumhcn2b3flc3tyu6dmlb4xa7u5bf44yegnrjhc4yeq"
    with pytest.raises(ValueError):
        content.cid_parse("nonsense")


def test_blobs(tmp_path):
    store = content.BlobStore(str(tmp_path / "blobs"))
    cid = content.compute_cid(b"data" * 100)
    assert store.compressed_size(cid) is None and store.store(cid, b"data" * 100) == store.store(cid, b"data" * 100) > 0
    assert store.read(cid) == b"data" * 100 and store.exists(cid) and content.unlz4(content.lz4(b"")) == b""
    with pytest.raises(FileNotFoundError):
        store.read(content.compute_cid(b"other"))


def test_display(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1 << 20: "1.0 MB", 3 << 30: "3.0 GB"}
    df = spark.createDataFrame([(k,) for k in sizes], "n long")
    assert dict(tuples(df.select("n", expr.format_size(F.col("n"))))) == sizes
    assert expr.log_name("/a b/c") == "errors_a_b_c.log" and expr.log_name("") == "errors_root.log"


def test_stream_merges_batches(spark, tmp_path):
    held = {"now": spark.createDataFrame([("/a", "old", 1, 1), ("/keep", "k", 1, 9)], "path string, cid string, original_size long, modified long")}
    put = lambda rows: spark.createDataFrame(rows, "path string, content binary, modified long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    save = lambda df, n: held.update(now=spark.createDataFrame(df.collect(), df.schema))
    run = lambda: ingest(spark, str(tmp_path / "in"), lambda: held["now"], save, str(tmp_path / "check")).awaitTermination()
    put([("/a", b"new", 5), ("/a", b"newer", 6), ("/b", b"b", 1), ("/keep", b"stale", 2)])
    run()
    put([("/b", b"again", 2)])
    run()
    got = {r.path: (r.original_size, r.modified) for r in held["now"].collect()}
    assert got == {"/a": (5, 6), "/b": (5, 2), "/keep": (1, 9)}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).fetch_df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    shown = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).to_numpy()))
    assert shown(got) == shown(want)
