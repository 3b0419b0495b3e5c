"""Member files cut into splits at any place, against ``csv.reader`` over the whole file."""

import csv
import io
import random

import pytest

from insidertrail.sources import bulk

HEADER = "FOOTNOTE_ID\tEXTRA\tACCESSION_NUMBER\tFOOTNOTE_TXT"


def whole(text, member="FOOTNOTES"):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter="\t"))
    at = {name: i for i, name in enumerate(rows[0])}
    return sorted((tuple(r[at[c]] if c in at and at[c] < len(r) else None for c in bulk.MEMBERS[member]) for r in rows[1:] if r), key=str)


def make(seed, n):
    rng = random.Random(seed)
    cells = ['plain', '5" pipe', '"quoted\ttab"', '"two\nlines"', '"say ""hi"""', '"a\n\nb ""\n"" c"', '', '""', '"open"tail', 'é"', '"\r\n"', "'", '"' + "long\n" * 30 + '"']
    return HEADER + "\n" + "".join("\t".join(rng.choice(cells) for _ in range(rng.randint(1, 5))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(n))


def test_quote_states_follow_the_reader():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('"\ta') for _ in range(rng.randint(0, 9)))
        for quoted in (False, True):
            # The reader goes on to a second line exactly where the first ends inside a quoted cell.
            rows = list(csv.reader(io.StringIO(('"' if quoted else "") + line + "\nX", newline=""), delimiter="\t"))
            assert bulk._ends_quoted(line.encode(), quoted) == (rows[-1] != ["X"]), (line, quoted)


def test_every_cut_gives_the_same_records():
    """The rules of the two passes without Spark, for splits at every place of a file."""
    data = make(3, 6).encode()
    want = [r for r in whole(data.decode())]
    lines, at = [], 0
    for line in data.split(b"\n")[:-1]:
        lines.append((at, line))
        at += len(line) + 1
    for size in (1, 2, 3, 5, 8, 13, 50, 10_000):
        splits = [(start, [x for n, x in lines if start <= n < start + size]) for start in range(0, len(data), size)]
        splits = [(start, own) for start, own in splits if own]
        opener, records, shared = None, [], {}
        for start, own in splits:
            if start == 0:
                own = own[1:]
            state, closes = opener is not None, False
            for who, record in bulk._records("f", start, iter(own), opener):
                records.append(record) if who is None else shared.setdefault(who, []).append(record)
            for line in own:
                state = bulk._ends_quoted(line, state)
                closes = closes or not state
            opener = (start if opener is None or closes else opener) if state else None
        text = HEADER + "\n" + b"".join(records + [b"".join(parts) for parts in shared.values()]).decode()
        assert whole(text) == want, size


@pytest.mark.parametrize("size", [40, 100_000])
def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, size):
    texts = [make(1, 20), make(2, 9) + "last\tx\trow", HEADER + "\na\tb\tc\t\"never closed\n", HEADER + "\n", HEADER + "\tMORE\nf\t\tacc\t\"x\ny\"\tz\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"q{i}").mkdir()
        (tmp_path / f"q{i}" / "FOOTNOTES.tsv").write_bytes(text.encode())
    settings = {"spark.sql.files.maxPartitionBytes": str(max(size, sum(map(len, texts)) // 40)), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in settings}
    try:
        for n, v in settings.items():
            spark.conf.set(n, v)
        got = bulk.read_member(spark, str(tmp_path), "FOOTNOTES").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sorted(map(tuple, got), key=str) == sorted((r for t in texts for r in whole(t)), key=str)


def test_a_missing_member_is_empty(spark, tmp_path):
    (tmp_path / "q").mkdir()
    assert bulk.read_member(spark, str(tmp_path), "FOOTNOTES").count() == 0
