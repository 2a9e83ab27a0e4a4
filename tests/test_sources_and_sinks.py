import pytest
from pyspark.sql import functions as F

from wordloom.operators import exports
from wordloom.operators.concordance import concordance_lines
from wordloom.operators.hits import find_hits
from wordloom.operators.patterns import word
from wordloom.sources import tables, tokens as token_source


def test_tokenise(spark):
    docs = spark.createDataFrame(
        [(1, "One two. Three,\nfour!? five"), (2, ""), (3, "   "), (4, "..."), (5, "Æ ø 12 a-b \n "), (6, None)], "id long, body string"
    )
    tokens = token_source.tokenise(docs, "id", "body")
    words = {}
    for r in tokens.orderBy("text_id", "tok_no").collect():
        words.setdefault(r.text_id, []).append((r.s_id, r.s_first, r.s_last, r.tok_no, r.word))
    assert [w[4] for w in words[1]] == ["One", "two", ".", "Three", ",", "four", "!", "?", "five"]
    assert [w[0] for w in words[1]] == [0, 0, 0, 1, 1, 1, 1, 2, 3]
    assert [w[3] for w in words[1]] == list(range(9))
    assert words[1][4][1:3] == (3, 6)
    assert [w[4] for w in words[5]] == ["Æ", "ø", "12", "a", "-", "b"] and {w[1:3] for w in words[5]} == {(0, 5)}
    assert [w[:4] for w in words[4]] == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 2, 2, 2)]
    assert set(words) == {1, 4, 5}


def test_positions(spark):
    docs = spark.createDataFrame([(3, "a b"), (1, "c"), (2, "")], "id long, body string")
    tokens = token_source.tokenise(docs, "id", "body")
    ranges = token_source.text_ranges(tokens, docs.select(F.col("id").alias("text_id")))
    found = {r.text_id: (r.n_tokens, r.startpos, r.endpos) for r in ranges.collect()}
    assert found == {1: (1, 0, 0), 2: (0, 1, 0), 3: (2, 1, 2)}


def test_metadata_file(spark, tmp_path):
    path = tmp_path / "texts.tsv"
    path.write_text("tid\tgenre\tyear$num\tstartpos\tendpos\nt1\tnews\t1990\t0\t9\nt2\t\\N\t\t10\t12\nt3\t\"q\t\\N\t13\t12\n")
    texts = tables.read_text_table(spark, str(path)).withColumn("n_tokens", F.col("endpos") - F.col("startpos") + 1)
    assert dict(texts.dtypes)["year"] == "bigint"
    rows = {r.text_id: (r.genre, r.year, r.n_tokens) for r in texts.collect()}
    assert rows == {"t1": ("news", 1990, 10), "t2": (None, None, 3), "t3": ('"q', None, 0)}
    path.write_text("tid\tyear$n\nt1\tmany\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_text_table(spark, str(path)).collect()


def test_bounds(spark):
    speakers = spark.createDataFrame([("s1", "0-4:10-32:34-34"), ("s2", ""), ("s3", "  ")], "text_id string, bounds string")
    rows = [(r.text_id, r.start, r.end) for r in tables.parse_bounds(speakers).orderBy("start").collect()]
    assert rows == [("s1", 0, 4), ("s1", 10, 32), ("s1", 34, 34)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.parse_bounds(spark.createDataFrame([("s1", "0-x")], "text_id string, bounds string")).collect()


def test_coordinates_and_media_files(spark, tmp_path):
    (tmp_path / "coords.tsv").write_text("Oslo\t59.9\t10.7\nÅl\t60.6\t8.6\n")
    assert {r.place: (r.lat, r.lng) for r in tables.read_coordinates(spark, str(tmp_path / "coords.tsv")).collect()} == {
        "Oslo": (59.9, 10.7), "Ål": (60.6, 8.6),
    }
    for name in ("audio/a.mp3", "video/a.mp4", "video/b.mp4", "audio/notes.txt"):
        file = tmp_path / "media" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    manifest = tables.media_manifest(tables.list_media(spark, str(tmp_path / "media")))
    assert {r.av_file: (r.has_audio, r.has_video) for r in manifest.collect()} == {"a": (True, True), "b": (False, True)}


def test_pivot(spark):
    rows = [(1, "sex", " f ", 1), (1, "age", "40", 2), (1, "age", "41", 5), (2, "age", None, 1)]
    values = spark.createDataFrame(rows, "text_id long, category string, value string, k long")
    texts = spark.createDataFrame([(1,), (2,), (3,)], "text_id long")
    wide = {r.text_id: (r.sex, r.age) for r in tables.pivot_values(values, ["sex", "age"], ["k"], texts).collect()}
    assert wide == {1: ("f", "41"), 2: ("", ""), 3: ("", "")}


def test_undefined_attribute(spark):
    rows = spark.createDataFrame([("__UNDEF__",), ("n",)], "pos_tag string")
    assert [r[0] for r in rows.select(tables.defined("pos_tag")).collect()] == [None, "n"]


@pytest.mark.parametrize("in_order", [True, False])
def test_stored_tokens(spark, tmp_path, in_order):
    docs = spark.createDataFrame([(i, "a b c. " * i) for i in range(20)], "id long, body string")
    source = token_source.arranged(docs, "id") if in_order else docs
    tokens = token_source.tokenise(source, "id", "body")
    token_source.save_tokens(tokens, str(tmp_path / "t"), in_order=in_order)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.where("word_folded <> lower(word)").count() == 0
    assert sorted(stored.drop("word_folded").collect()) == sorted(tokens.collect())
    for part in stored.withColumn("file", F.input_file_name()).groupBy("file").agg(F.collect_list(F.struct("text_id", "tok_no")).alias("k")).collect():
        assert part.k == sorted(part.k)


def test_concordance_files(spark, make_tokens, tmp_path):
    tokens = make_tokens({1: [["say", '"', "x", "now"]], 2: [["x"]]})
    lines = concordance_lines(find_hits(tokens, [[word("x")]]), tokens).withColumn("pos", F.col("startpos") + F.col("start"))
    lines = lines.withColumn("segment", F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))).withColumn("genre", F.lit("n"))
    export = exports.concordance_export(lines, {"genre": "Genre"})
    assert export.columns == ["Corpus position", "Sentence ID", "Genre", "Left context", "Match", "Right context"]
    wanted = [("2", "1.0", "n", 'say "', "x", "now"), ("4", "2.0", "n", None, "x", None)]
    exports.write_table(export.coalesce(1), str(tmp_path / "c"), "csv")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()] == wanted
    exports.write_table(export.coalesce(1), str(tmp_path / "t"), "tsv", header=False)
    texts = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert texts == ['2\t1.0\tn\tsay "\tx\tnow', "4\t2.0\tn\t\tx\t"]
    assert exports.concordance_export(lines, spoken=True).columns[1] == "Informant ID"
    with pytest.raises(ValueError):
        exports.write_table(export, str(tmp_path / "x"), "xlsx")


def test_frequency_file(spark, tmp_path):
    counted = spark.createDataFrame([(3, "a"), (1, "b,c")], "n long, word string")
    exports.write_table(exports.frequency_export(counted.orderBy(F.desc("n")), {"word": "Word form"}).coalesce(1), str(tmp_path / "f"), "csv")
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ['"Count","Word form"', '"3","a"', '"1","b,c"']


def test_running_text(spark, make_tokens, tmp_path):
    words = [f"w{i}" for i in range(9000)]
    pieces = exports.running_text(make_tokens({1: [words], 2: [["z"]]}), "word")
    assert {(r.text_id, r.block): len(r.value.split()) for r in pieces.collect()} == {(1, 0): 4096, (1, 1): 4096, (1, 2): 808, (2, 0): 1}
    exports.write_running_text(pieces, str(tmp_path / "text"))
    files = sorted((tmp_path / "text").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == words + ["z"]
