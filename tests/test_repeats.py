"""Repeated sheets against one pass over the sheets of a file, largest first."""

import random

from spendalloc.sources import cells as K

SCHEMA = "source_seq int, sheet string, staff_id_raw string, national_id_raw string, person_raw string, row_no int, repeats_of string"


def one_pass(sheets):
    """sheets: name -> persons in row order, in the order of the file."""
    order = sorted(sheets, key=lambda s: (-len(set(sheets[s])), list(sheets).index(s)))
    primary, out = [], {}
    for s in order:
        mine = set(sheets[s])
        near = [p for p in primary if len(mine) >= 10 and len(mine & set(sheets[p])) >= 0.8 * len(mine)]
        out[s] = near[0] if near else None
        if not near:
            primary.append(s)
    return out


def test_as_one_pass(spark):
    rnd = random.Random(3)
    files = {}
    for f in range(4):
        sheets = {}
        # Windows that slide by one person: long chains of sheets that contain most of the next one.
        for i in range(rnd.randint(5, 40)):
            sheets[f"w{i}"] = list(range(i, i + 12 - (i % 3)))
        for i in range(12):
            pick = rnd.sample(range(60), rnd.choice([8, 9, 10, 15, 30]))
            sheets[f"r{i}"] = pick
            sheets[f"again{i}"] = pick[::-1] + pick[:2]
            sheets[f"part{i}"] = pick[:-2]
        names = list(sheets)
        rnd.shuffle(names)
        files[f] = {n: sheets[n] for n in names}
    rows = [(f, s, str(k), None, None, 0, "kept") for f, sheets in files.items() for s, ks in sheets.items() for k in ks]
    rows = [(*r[:5], n, r[6]) for n, r in enumerate(rows)]
    rows += [(0, "", "1", None, None, 10**6, "kept"), (0, None, "1", None, None, 10**6, "kept"),
             (0, "nobody", None, None, None, 10**6, "kept")]
    rnd.shuffle(rows)
    got = K.mark_repeat_sheets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r["repeats_of"] for r in got} == {"kept"}
    mine = {}
    for r in got:
        mine.setdefault((r["source_seq"], r["sheet"]), set()).add(r["repeats"])
    for f, sheets in files.items():
        want = one_pass(sheets)
        assert {s: mine[(f, s)] for s in sheets} == {s: {want[s]} for s in sheets}
    assert mine[(0, "")] == mine[(0, None)] == mine[(0, "nobody")] == {None}


def test_no_sheets(spark):
    assert K.mark_repeat_sheets(spark.createDataFrame([], SCHEMA)).count() == 0
