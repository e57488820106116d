from docspark.operators import attachments
from docspark.operators.anonymize import Anonymizer, attachment_names


def test_sizes_are_kept():
    png = attachments.blank_png(37, 11)
    assert attachments.image_size(png) == (37, 11)
    assert attachments.image_size(b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little")) == (5, 6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x00\x00\x00"
    assert attachments.image_size(jpeg) == (9, 7) and attachments.image_size(b"no") is None
    out = attachments.anonymized("a.PNG", png, Anonymizer())
    assert attachments.image_size(out) == (37, 11)


def test_diagrams_and_stubs():
    xml = '<mxfile><mxCell id="2" value="Secret thing" style="x"></mxCell></mxfile>'
    out = attachments.anonymized("d.drawio", xml.encode(), Anonymizer()).decode()
    assert "Secret" not in out and 'style="x"' in out and 'id="2"' in out
    assert attachments.anonymized("x.pdf", b"data", Anonymizer()) == attachments.STUB


def test_table(spark):
    df = spark.createDataFrame([("p", "a.png", bytearray(attachments.blank_png(3, 4))), ("p", "b.bin", None), ("p", None, bytearray(b"x"))], "page_id string, name string, bytes binary")
    rows = attachments.anonymize_attachments(df).collect()
    assert [attachments.image_size(bytes(r.bytes)) for r in rows[:1]] == [(3, 4)] and rows[0].name.endswith(".png") and rows[1].bytes is None and rows[2].name is None
    named = attachment_names(df.filter("name is not null").select("page_id", "name")).collect()
    assert {r.name: r.new_name for r in named} == {"a.png": "file_1.png", "b.bin": "file_2"}
