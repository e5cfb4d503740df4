"""Archives, XML, catalogues, Arrow files with images, and operators whose tables can't tell wrong from right."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import sampling, scoring, sequences
from loamgrid.sources import files

PROSE, MORE = "Supported explanation. " * 5, "Further <i>detail</i> stands here. " * 5
ARTICLE = f"""<book-part><book-part-meta><title-group><title>Topic</title></title-group></book-part-meta><body><sec id="a"><title>Over<b>view</b></title><p>{PROSE}</p>
<sec id="b"><title>Details</title><p>{MORE}</p><fig><p>{PROSE}</p></fig></sec><list><list-item><p>{PROSE}</p></list-item></list></sec>
<sec id="q"><title>Review Questions</title><p>{PROSE}</p><sec><title>Inside</title><table-wrap>{PROSE}</table-wrap><p>short</p></sec></sec></body></book-part>"""


def test_xml_passages_are_direct_parts_of_sections_with_prose(spark):
    m = spark.createDataFrame([("one", ARTICLE), ("two", f"<r><title>First</title><body><sec><p>{PROSE}</p></sec></body></r>"), ("none", None)], "member string, text string")
    clean = lambda x: " ".join(x.replace("<i>", " ").replace("</i>", " ").split())
    got = {(r.member, r.section, r.place, r.title, r.text) for r in files.xml_passages(m).collect()}
    assert got == {
        ("one", "a", 1, "Topic -- Overview", clean(PROSE)), ("one", "a", 3, "Topic -- Overview", clean(PROSE)), ("one", "b", 1, "Topic -- Details", clean(MORE)),
        ("one", "Inside", 1, "Topic -- Inside", clean(PROSE)), ("two", "", 0, "First -- ", clean(PROSE)),
    }
    assert {r.text for r in files.xml_passages(m, passages=("fig",), no_prose="^over").collect()} == {clean(PROSE)}


def test_catalogue_of_topics_in_an_archive(spark, tmp_path):
    topic = '<health-topic id="{}" title="T{}" url="u" language="{}"><full-summary>&lt;p&gt;Text &amp;amp; more</full-summary>{}</health-topic>'
    groups = '<group id="7">Heart</group><group id="8">Blood</group>'
    xml = f"<health-topics>{topic.format(1, 1, 'English', groups)}{topic.format(2, 2, 'Spanish', groups)}{topic.format(3, 3, 'English', '')}</health-topics>"
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("topics.xml", xml)
    (tmp_path / "t.zip").write_bytes(body.getvalue())
    got = files.topic_catalogue(files.zip_members(spark, str(tmp_path / "t.zip")), "English").orderBy("id").collect()
    assert [(r.id, r.title, r.summary, [tuple(g) for g in r.groups]) for r in got] == [("1", "T1", "<p>Text &amp; more", [("7", "Heart"), ("8", "Blood")]), ("3", "T3", "<p>Text &amp; more", [])]


def test_arrow_files_with_embedded_images(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001F40000012C08060000") + b"x" * 9
    gif = b"GIF89a" + bytes([10, 1, 20, 0]) + b"y" * 20
    image = pa.struct([("bytes", pa.binary()), ("path", pa.string())])
    rows = pa.table({"image": pa.array([{"bytes": png, "path": "a.png"}, {"bytes": gif, "path": None}, {"bytes": b"?", "path": "z"}, None], image), "question": ["q1", "q2", "q3", "q4"], "other": [1, 2, 3, 4]})
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), rows.schema) as w:
        w.write_table(rows.slice(0, 2))
    with pa.ipc.new_stream(str(tmp_path / "b.arrow"), rows.schema) as w:
        w.write_table(rows.slice(2))
    got = files.embedded_images(files.read_arrow(spark, str(tmp_path), "image struct<bytes:binary,path:string>, question string"), "image")
    found = {r.question: (r.image_path, r.image and (r.image.bytes, r.image.kind, r.image.width, r.image.height)) for r in got.collect()}
    assert found == {"q1": ("a.png", (len(png), "png", 500, 300)), "q2": (None, (30, "gif", 266, 20)), "q3": ("z", (1, None, None, None)), "q4": (None, None)}


def test_replaced_rows_are_there_at_any_time(spark, tmp_path):
    at, schema = str(tmp_path / "out"), "id int"
    files.replace_jsonl(spark.range(3), at)
    reader = files.read_replaced(spark, at, schema)  # opened before the next two versions: the first of them leaves its rows
    files.replace_jsonl(spark.range(5), at)
    assert reader.count() == 3 and files.read_replaced(spark, at, schema).count() == 5
    files.replace_jsonl(spark.range(7), at)
    assert files.read_replaced(spark, at, schema).count() == 7 and len(list((tmp_path / "out").glob("rows-*"))) == 2


def test_history_pairs_the_first_waiting_question(spark):
    said = ["user:u1", "tool:t", "user:u2", "assistant:a1", "assistant:a2", "system:s", "assistant:a3", "user:u3", "user:u4"]
    df = spark.createDataFrame([(1, i, *m.split(":")) for i, m in enumerate(said)], "conv_id int, turn int, role string, text string")
    assert [(r.first, r.second) for r in sequences.compressed_history(df, recent=0).collect()] == [("u1", "a1")]
    got = sequences.compressed_history(df, recent=5).orderBy("kind", "at").collect()
    assert [(r.kind, r.first, r.second) for r in got] == [("message", *m.split(":")) for m in said[4:]] + [("pair", "u1", "a1")]
    assert sequences.compressed_history(df).where("kind = 'pair'").count() == 0  # ten messages stay whole


def test_a_missing_judge_is_no_failure_of_the_case(spark):
    checks = spark.createDataFrame([(1, 1, True, True), (2, 1, True, True), (3, 1, True, False)], "case_id int, check_id int, critical boolean, executed boolean")
    verdicts = spark.createDataFrame([(1, 1, "x", "fail"), (2, 1, "x", "pass"), (2, 1, "y", "pass")], "case_id int, check_id int, judge string, verdict string")
    judged = scoring.judged_checks(checks, verdicts)
    assert {(r.case_id, r.verdict, r.judge_error) for r in judged.collect()} == {(1, "uncertain", True), (2, "pass", False), (3, "not_executed", False)}
    assert {(r.case_id, r.status, r.critical_failed_both) for r in scoring.case_rollup(judged).collect()} == {(1, "judge_error", False), (2, "graded", False), (3, "graded", False)}


@pytest.mark.parametrize("width", [1, 4, 7])
def test_sentence_spans_make_up_the_text(spark, width):
    texts = ["First sentence. Second longer sentence here now. Final.", "word " * 23, "a.\n\nb c d! e", "", None, "One. " + "w " * 30 + "end. Two."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sampling.sentence_spans(df, "id", "t", width).orderBy("id", "start").collect()
    for i, t in enumerate(texts):
        own = [(r.start, r.stop) for r in got if r.id == i]
        assert [x for a, b in own for x in range(a, b)] == list(range(len((t or "").split()))) and all(0 < b - a <= width for a, b in own)
    if width == 4:
        assert [(r.start, r.stop) for r in got if r.id == 0] == [(0, 2), (2, 6), (6, 8)]  # "Second longer sentence here" is cut: no end in its second half


def test_sets_are_compared_in_both_directions(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert tuple(sampling.same_set(a, b, "k").first()) == (1, 2, False) and sampling.same_set(a, a.distinct(), "k").first().same
