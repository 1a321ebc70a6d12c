"""CSV by ranges against the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tracklens.sources import texts
from tracklens.sources.ranges import Window


def whole(raw):
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("gb18030")
    return [[(k, v or "") for k, v in r.items() if k is not None] for r in csv.DictReader(io.StringIO(text))]


def opened(raw):
    f = io.BytesIO(raw)
    f.read_at = lambda n, at: raw[at : at + n]
    return Window(f, len(raw))


def by_ranges(raw, split):
    """What survey and records do, range by range in one process."""
    told = [(s, min(len(raw), s + split), *texts._surveyed(opened(raw), s, min(len(raw), s + split))) for s in range(0, len(raw), split)]
    utf8 = all(u and h == (told[i - 1][4] if i else 0) for i, (_, _, u, h, _, _) in enumerate(told))
    state, out = "S", []
    for start, end, _, _, _, states in told:
        out += list(texts.records(opened(raw), start, end, "utf-8-sig" if utf8 else "gb18030", state))
        state = states[texts.STATES.index(state)]
    return out


SAMPLES = {
    "plain": "a,b\n1,2\n3,4\n\n5\n6,7,8\n",
    "quoted": 'a,b\n"x, ""y""\nz",1\n"",2\n5" pipe,3\n"open\n\nlines",4\nend,"5"',
    "crlf": 'a,b\r\n1,"x\r\ny"\r\n2,\r\n',
    "wide": "名,é,😀\n甲,乙,丙\n\"甲\n乙\",é😀,\n" * 1,
    "behind": 'a,b\n"x"y,1\n"p""",2\n,""\n',
    "header": "a,b",
    "long": "a,b\n" + "x" * 300 + ',"' + "y\n" * 200 + '"\n1,2\n',
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("code", ["utf-8", "utf-8-sig", "gb18030"])
def test_every_split_gives_the_records_of_the_whole_file(name, code):
    raw = SAMPLES[name].encode(code)
    want = whole(raw)
    for split in (4, 5, 7, 8, 13, 40, 10_000):
        assert by_ranges(raw, split) == want, split


def test_random_files_and_broken_bytes():
    rng = random.Random(3)
    for _ in range(150):
        text = "h,é\n" + "".join(rng.choice(['"', ",", "\n", "é", "中", "x", '""', "\n"]) for _ in range(60))
        raw = text.encode(rng.choice(["utf-8", "gb18030"]))
        if rng.random() < 0.3:
            raw = raw[:20] + "中".encode("gb18030") + raw[20:]
        try:
            want = whole(raw)
        except (UnicodeDecodeError, csv.Error):
            continue
        for split in (4, 7, 30):
            assert by_ranges(raw, split) == want, (raw, split)


def test_states_are_those_of_the_parser():
    for piece, start, end in ((b'"a,b', "S", "Q"), (b'a"b', "S", "F"), (b'""', "Q", "Q"), (b'"', "Q", "E"), (b"\n", "E", "S"), (b"z", "E", "F"), (b"", "Q", "Q")):
        assert texts.carried(piece, start) == end
    a, b = b'1,"x""y', b'z",\n"q'
    assert texts.carried(b, texts.carried(a)) == texts.carried(a + b)


def test_files_in_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(str(i), rng.choice(["plain", 'say "hi", then\nleave', "é中", ""]), "x" * rng.randrange(30)) for i in range(3000)]
    for name, code in (("u.csv", "utf-8-sig"), ("g.csv", "gb18030")):
        with (tmp_path / name).open("w", encoding=code, newline="") as f:
            csv.writer(f).writerows([("id", "t", "only" if name[0] == "g" else "z"), *rows])
    found = texts.survey(spark, str(tmp_path), 4096)
    assert found.count() > 20 and {(r.file[-5:], r.encoding) for r in found.collect()} == {("u.csv", "utf-8-sig"), ("g.csv", "gb18030")}
    got = texts.read_csv_auto(spark, str(tmp_path), split_bytes=4096)
    for name, other in (("u.csv", "z"), ("g.csv", "only")):
        one = got.where(F.col("file").endswith(name)).orderBy("row").collect()
        assert [(r.id, r.t, r[other]) for r in one] == rows and [r.row for r in one] == list(range(3000))
        assert {r["only" if other == "z" else "z"] for r in one} == {None}
