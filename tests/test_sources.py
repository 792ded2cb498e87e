"""Line files, written splits, preparation over odd rows, and the stream."""

from pyspark.sql import functions as F

from glyphstream.functions import text as X
from glyphstream.operators import prep
from glyphstream.sources import files, texts


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {k} " + "é" * (k % 7) for k in range(3000)] + ["", "a\x0bb", "", "c d\x85e", "", "last"]
    (tmp_path / "en").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "fr").write_text("é\r\nx\r\n", encoding="utf-8")
    want = ("\n".join(lines) + "\n").splitlines()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "en")).orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.line_id, r.text) for r in got] == list(enumerate(want))
    rows = files.parallel_lines(spark, {x: str(tmp_path / x) for x in ("en", "fr")}, "dev").where("lang = 'fr'").orderBy("sent_id").collect()
    assert [(r.split, r.sent_id, r.text) for r in rows] == [("dev", 0, "é"), ("dev", 1, "x")]
    assert files.resolve(spark, "fr", str(tmp_path)).endswith("/fr") and files.resolve(spark, "/x/y", str(tmp_path)) == "/x/y"


def test_written_files_read_back(spark, tmp_path):
    rows = [(1, 'a "b"\n\\c '), (2, ""), (3, None), (4, "é😀\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts.write_json_strings(df, f"{tmp_path}/j")
    assert sorted(r.text for r in texts.json_strings(spark, f"{tmp_path}/j").collect()) == sorted(t for _, t in rows if t is not None)
    files.write_routed(df.withColumn("split", F.when(F.col("doc_id") < 3, "held").otherwise("train")), f"{tmp_path}/r", "split")
    assert spark.read.parquet(f"{tmp_path}/r/split=held").count() == 2
    s = files.rewrite_without(df, df.where("doc_id = 1"), "doc_id", f"{tmp_path}/w").first()
    assert (s.before, s.kept, s.bytes) == (4, 3, len("é😀\t".encode()))
    got = files.registry(spark, [("a", "1"), ("b", "x"), ("c", "2")], int, ["a", "b"]).collect()
    assert [(r.name, r.value, r.error) for r in got] == [("a", "1", None), ("b", None, "ValueError")]


def test_preparation_keeps_odd_rows(spark):
    rows = [(1, "same"), (2, "same"), (None, "same"), (None, "alone"), (3, "twice"), (3, "twice"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "", r.dup) for r in prep.first_of_equal(df).collect())
    assert got == sorted([(1, "same", False), (2, "same", True), (0, "same", True), (0, "alone", False), (3, "twice", False), (3, "twice", False), (4, "", False), (5, "", True)])
    assert sorted((r.doc_id or 0, r.text or "") for r in prep.distinct_texts(df).collect()) == [(0, "alone"), (1, "same"), (3, "twice"), (4, "")]
    bench = spark.createDataFrame([("one two three",)], "text string")
    mixed = spark.createDataFrame([(None, "x one two three y"), (None, "one two"), (1, "One two three"), (1, "zero one two three")], "doc_id long, text string")
    got = {r.text: r.contaminated for r in prep.word_contaminated(mixed, bench, 3).collect()}
    assert got == {"x one two three y": True, "one two": False, "One two three": False, "zero one two three": True}


def test_running_sums_with_skew_nulls_and_groups(spark):
    ids = [*range(50), 10**12, 10**12 + 1, None]
    rows = [(i, g, k + 1) for g in ("a", None) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "i long, g string, n long").repartition(3)
    for by in (["g"], None):
        got = prep.running(df, "n", "i", by, buckets=8).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [x for x in rows if not by or x[1] == r.g]
            less = sum(n for i, _, n in mine if i is not None and (r.i is None or i < r.i))
            same = sum(n for i, g, n in mine if i == r.i and (g != r.g or by))
            assert r.before in ({less} if by else {less, less + same})
    assert prep.running(df.limit(0), "n", "i").count() == 0


def test_strip_utf8_and_windows(spark):
    raw = [b"ab", "é".encode()[:1], b"a" + "😀".encode()[:3], b"\xff\xfe", b""]
    df = spark.createDataFrame([(x,) for x in raw], "b binary")
    got = df.select(X.valid_utf8(F.col("b")).alias("v"), X.lossy_utf8(F.col("b")).alias("t")).collect()
    for x, r in zip(raw, got):
        try:
            x.decode()
            ok = True
        except UnicodeDecodeError:
            ok = False
        assert r.v == ok and r.t == x.decode(errors="replace")
    s = "  \x1c a b \n"
    assert spark.createDataFrame([(s,)], "t string").select(X.strip(F.col("t")).alias("t")).first().t == s.strip()
    stream = spark.range(23).withColumnRenamed("id", "pos")
    rows = X.fixed_windows(stream, "pos", 5).groupBy("window").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert {r.window: r.p for r in rows} == {w: list(range(5 * w, 5 * w + 6)) for w in range(4)}
    burmese = "မြန်မာနိုင်ငံ"
    assert spark.createDataFrame([(burmese,)], "t string").select(X.syllable_starts(F.col("t")).alias("n")).first().n == 4


def test_stream_drops_short_and_repeated(spark, tmp_path):
    from glyphstream.streaming.prep import clean_stream

    long, other = "x" * 300, "y" * 300
    rows = [(1, long, "2024-01-01 00:00:00"), (2, long, "2024-01-01 00:01:00"), (3, "short", "2024-01-01 00:02:00"), (4, other, "2024-01-01 00:03:00"), (5, None, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clean_stream(spark.readStream.schema("doc_id long, text string, at timestamp").parquet(f"{tmp_path}/in"), "at")
    q = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.doc_id for r in spark.table("cleaned").collect()) == [1, 4]
