import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farfield.functions import text as T
from farfield.sources import files
from farfield.streaming.sources import replay


def parse(spark, line, dims=None):
    return spark.createDataFrame([(line,)], "v string").select(T.parse_point(F.col("v"), dims)).first()[0]


@pytest.mark.parametrize(
    "line, want",
    [
        ("1 2.5 -3e2 ", [1.0, 2.5, -300.0]),
        ("1  2", [1.0, 0.0, 2.0]),  # the empty word between two blanks hashes to zero
        ("tcp", [114657.0]),
        ("TCP 1f 2D .5 5.", [114657.0, 1.0, 2.0, 0.5, 5.0]),
        ("nan", [108827.0]),  # words, not numbers
        ("infinity", [float(173173288)]),
        ("", [0.0]),
        ("   ", []),
        ("1 2 3 4", [1.0, 2.0, 3.0, 4.0]),
    ],
)
def test_parse(spark, line, want):
    assert parse(spark, line) == want


def test_parse_keeps_the_first_dims(spark):
    assert parse(spark, "1 2 3 4", 2) == [1.0, 2.0]


def test_hash_wraps_and_uses_utf16(spark):
    def plain(word):
        units = word.encode("utf-16-le")
        h = 0
        for low, high in zip(units[::2], units[1::2]):
            h = (h * 31 + (low | high << 8)) & 0xFFFFFFFF
        return float(h - (1 << 32) if h >= 1 << 31 else h)

    for word in ("guess_passwd", "a considerably longer word", "zażółć", "😀x", "x"):
        got = spark.createDataFrame([(word,)], "w string").select(T.string_hash(F.col("w"))).first()[0]
        assert got == plain(word)


def test_hashes_of_lists(spark):
    lists = [["ab", "", None, "é" * 3000], [], None, ["x"]]
    got = spark.createDataFrame([(k, w) for k, w in enumerate(lists)], "k int, w array<string>").select("k", T.string_hashes(F.col("w")).alias("h"))
    rows = [r["h"] for r in got.orderBy("k").collect()]
    assert rows[1:3] == [[], None] and rows[3] == [120.0] and rows[0][:3] == [3105.0, 0.0, None]
    h = 0
    for _ in range(3000):
        h = (h * 31 + 0xE9) & 0xFFFFFFFF
    assert rows[0][3] == float(h - (1 << 32) if h >= 1 << 31 else h)


def test_places_follow_files_and_filters(spark, tmp_path):
    for name, text in (("a", ""), ("b", "x 1\n\nx 2\n"), ("c", "\nx 3\nx 4"), ("d", "x 5\n")):
        (tmp_path / name).write_text(text)
    kept = files.lines(spark, str(tmp_path)).filter("value <> ''")
    rows = files.in_file_order(kept).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in rows] == [(k, f"x {k + 1}") for k in range(5)]
    keyed = files.vector_lines(spark, str(tmp_path / "[ad]")).collect()
    assert [(r["key"], r["x"]) for r in keyed] == [("x", [5.0])]


def write(path, *lines):
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


def test_keyed_points(spark, tmp_path):
    path = write(tmp_path / "p", "a 1 2 0", "b 3 4", "", "c 5 x 1 ")
    rows = files.keyed_points(spark, path, 2).orderBy("pos").collect()
    assert [(r["key"], r["x"], r["label"]) for r in rows] == [
        ("a", [1.0, 2.0], 0), ("b", [3.0, 4.0], None), ("c", [5.0, 120.0], 1),
    ]
    assert rows[0]["value"] == "1 2 "


def test_keys_run_over_all_files_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "b.txt", *(f"b{i} 1 0" for i in range(3)))
    write(folder / "a.txt", *(f"a{i} 1 0" for i in range(200)))
    rows = files.assign_keys(spark, str(folder)).orderBy("key").collect()
    assert [r["key"] for r in rows] == list(range(1, 204))
    assert rows[0]["line"] == "1 a0 0" and rows[200]["line"] == "201 b0 0"


def test_vector_lines(spark, tmp_path):
    keyed = write(tmp_path / "keyed", "Hans 12 24 18.5", "Jane 13 19 -12.0", "Ann 1 2 3")
    rows = files.vector_lines(spark, keyed, max_rows=2).orderBy("pos").collect()
    assert [(r["key"], r["x"]) for r in rows] == [("Hans", [12.0, 24.0, 18.5]), ("Jane", [13.0, 19.0, -12.0])]
    bare = write(tmp_path / "bare", "1 2", "3 4")
    assert [r["x"] for r in files.vector_lines(spark, bare).orderBy("pos").collect()] == [[1, 2], [3, 4]]
    uneven = write(tmp_path / "uneven", "1 2", "3 4 5")
    with pytest.raises(Exception, match="unexpected row length"):
        files.vector_lines(spark, uneven, expected_columns=2).collect()


def test_class_records(spark, tmp_path):
    features = ",".join(str(j) for j in range(41))
    path = write(tmp_path / "k", *(f"{features},{c}." for c in ("normal", "smurf", "back", "normal")))
    rows = files.classed_records(spark, path).orderBy("key").collect()
    assert [(r["key"], r["label"]) for r in rows] == [(1, 0), (2, 1), (3, 0)]
    assert rows[1]["line"] == "2 " + features.replace(",", " ") + " 1"


def test_last_label_of_a_key_wins(spark, tmp_path):
    sink = write(tmp_path / "s", "[X]: 7, 0", "[X]: 8, 1", "[X]: 7, 1")
    got = {r["key"]: r["label"] for r in files.read_labels(spark, sink, sink=True).collect()}
    assert got == {"7": 1, "8": 1}
    data = write(tmp_path / "d", "7 0.5 0", "8 0.5 1")
    assert {r["key"]: r["label"] for r in files.read_labels(spark, data).collect()} == {"7": 0, "8": 1}


def test_expected_files(spark, tmp_path):
    profiles = write(tmp_path / "e", "p 1.5 2 : 3=1.25")
    assert tuple(files.expected_profiles(spark, profiles).first()) == (1.5, 2.0, 1.25)
    outliers = write(tmp_path / "o", "1 2 Noise", "1 2 Noise", "3 4 Noise")
    assert files.expected_outliers(spark, outliers).count() == 2


def test_appending(spark, tmp_path):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    for _ in range(2):
        files.append_lines(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_names_round_trip(spark):
    name = T.run_name("Wilt", 5, "RLOF", 7, "EUCLIDEAN", "TABLES", 2, 4, None, 500, 10, 2000)
    assert name == "wilt-d5-rlof-k7-euc-tables-h2-t4-w500-i10-a2000"
    assert T.run_name("m", 2, "ilof", 3, "MANHATTAN", "PLANES", planes=6, tables=2) == "m-d2-ilof-k3-man-planes-p6-t2"
    row = spark.createDataFrame([(name + "-1234ms",)], "run string")
    found = row.select(*(c.alias(n) for n, c in T.run_parameters(F.col("run")).items())).first()
    assert found.asDict() == {
        "dims": 5, "k": 7, "hashes": 2, "planes": None, "tables": 4, "window": 500,
        "inlier_percent": 10, "max_age": 2000, "ms": 1234,
    }


def test_second_last_column(spark):
    row = spark.createDataFrame([("a b c d",), ("a b",), ("a",)], "v string")
    got = [r[0] for r in row.select(T.without_second_last(F.split("v", " "))).collect()]
    assert got == [["a", "b", "d"], ["b"], ["a"]]


def test_replay_keeps_order(spark, tmp_path):
    records = spark.range(10).selectExpr("cast(id as string) key", "'1 ' value", "id + 5 seq")
    path = replay(records, 3, str(tmp_path / "r"))
    stamped = spark.read.parquet(path).select("seq", F.col("_metadata.file_modification_time").alias("t"))
    assert [r["seq"] for r in stamped.orderBy("t", "seq").collect()] == list(range(5, 15))


def test_words_are_hashed_in_bounded_pieces(monkeypatch):
    words = pa.array(["a", "1.5", None, "word" * 40, "", "-2e1f", "é"] * 30, pa.string())
    whole, sizes = T._spelled(words), []
    lists = pa.ListArray.from_arrays(pa.array([0, 100, 100, 210], pa.int32()), words)
    monkeypatch.setattr(T, "PIECE", 16)
    monkeypatch.setattr(T, "PIECE_BYTES", 50)
    found = T._in_pieces(lists, lambda some: sizes.append((len(some), sum(len(w or "") for w in some.to_pylist()))) or T._spelled(some))
    assert found.value_lengths().to_pylist() == [100, 0, 110]
    assert [w for some in found.to_pylist() for w in some] == [None if w is None else v for v, w in zip(whole, words.to_pylist())]
    assert all(n <= 16 and (size <= 50 or n == 1) for n, size in sizes)
