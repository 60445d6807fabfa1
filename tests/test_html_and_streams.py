import pytest
from pyspark.sql import functions as F

from letterlens.functions import html_text as HT
from letterlens.operators import audit as A
from letterlens.streaming import append_chain

PAGES = [
    (None, ""), ("", ""), (" \n ", ""), ("plain  text\n here", "plain text here"),
    ("<p>A</p><p>B</p>", "A B"), ("<b>bo</b>ld", "bo ld"),
    ("<head><title>t</title><meta name='a' content='b'></head><body>seen</body>", "seen"),
    ("<script>if (a < b) { x('</p>'); }</script>after", "after"), ("<style>p > a {}</style>x", "x"),
    ("<a title='a > b'>link</a>", "link"), ("<!-- <p>no</p> -->yes", "yes"), ("a<!DOCTYPE html>b", "a b"),
    ("&eacute;&hellip;&copy;&NotEqualTilde; &#233;&#x20AC;&#128;", "é…©≂̸ é€€"), ("&nbsp;x&nbsp;", "x"), ("a &amp;lt; b", "a &lt; b"),
    ("<p>open <b>all the way", "open all the way"), ("a</b>b</head>c", "a b c"), ("x<br/>y<br>z", "x y z"),
    ("<head>never closed <p>hidden", ""), ("<div><head>h</div>shown", "shown"), ("<template><p>t</p></template>u", "u"),
    ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kan"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<P CLASS=x>UP</P>", "UP"),
    ("<p>" + "word " * 50_000 + "end</p>", "word " * 50_000 + "end"), ("<div>" * 3_000 + "deep", "deep"),
]


def test_exact_text_of_odd_pages(spark):
    rows = [(i, h) for i, (h, _) in enumerate(PAGES)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, html string").select("i", HT.exact_visible_text(F.col("html")).alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}


EVENTS = "case_id string, place string, event_type string, event_timestamp timestamp, actor_type string, actor_id string, message string, metadata string"


@pytest.mark.parametrize("cut", [4, 9])
def test_a_stream_goes_on_from_a_stored_chain(spark, tmp_path, cut):
    e = spark.range(12).selectExpr("concat('c', id % 3) as case_id", "lpad(cast(id as string), 3, '0') as place", "'T' as event_type", "timestamp '2024-01-01' as event_timestamp",
                                   "'system' as actor_type", "cast(null as string) as actor_id", "concat('m', id) as message", "cast(null as string) as metadata")
    want = {(r.case_id, r.event_sequence, r.previous_event_hash, r.event_hash) for r in A.build_chain(e).collect()}
    stored = A.build_chain(e.where(F.col("place").cast("int") < cut))
    stored.write.parquet(str(tmp_path / "stored"))
    src = str(tmp_path / "ev")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        rows = append_chain(spark.readStream.schema(e.schema).parquet(src), spark.read.parquet(str(tmp_path / "stored")))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "new")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    try:
        for low, high in ((cut, 11), (11, 12)):
            e.where(F.col("place").cast("int").between(low, high - 1)).coalesce(1).write.mode("append").parquet(src)
            run()
    finally:
        spark.conf.unset(conf)
    columns = ("case_id", "event_sequence", "previous_event_hash", "event_hash")
    new = {tuple(r) for r in spark.read.parquet(str(tmp_path / "new")).select(*columns).collect()}
    old = {tuple(r) for r in spark.read.parquet(str(tmp_path / "stored")).select(*columns).collect()}
    assert old | new == want and len(new) == 12 - cut
