"""The filter audit against applying the filters one after another."""

import re
from itertools import permutations

from tessera.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, failed int, n int"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain_audit(rows, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    first = {}
    for i, t, *_ in rows:
        i = float("inf") if i is None else i
        first[t or ""] = min(first.get(t or "", i), i)

    def fails(i, t):
        t, w = t or "", words(t)
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": (float("inf") if i is None else i) > first[t],
        }

    good, toxic = ({i for i, *marks in ((r[0], r[1], r[2]) for r in labels) if i is not None and marks[k] == 1} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], fails(r[0], r[1])) for r in rows if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if own[k][1][f]]
                redundant = sum(x[f] for k, (_, x) in enumerate(own) if k not in left)
                left = [k for k in left if k not in gone]
                unique = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(own[k][0] in good for k in gone), sum(own[k][0] in toxic for k in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def test_audit_is_the_filters_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "a b c", None), (4, long, "en"), (5, long, "de"), (5, long, "de"), (6, long, ""), (None, long, "en"), (7, "w " * 300, "en"), (8, "W X " * 300, "de"),
        (9, long + " #", "en"), (10, long + " ÄÖ\x0b x", "fr"), (11, "ABC " + long, "fr"), (None, "only here", None), (None, "only here", None), (12, " \t\n ", "fr"),
    ]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1), (9, None, 1), (99, 1, 1), (1, 1, None), (8, 0, 0)]
    docs = spark.createDataFrame([(*r, "p", 3, 4) for r in rows], DOCS)
    marks = spark.createDataFrame([(*r, "q") for r in labels], LABELS)
    got = filter_audit.audit(docs, marks).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4
    bare = filter_audit.audit(docs, marks.limit(0)).collect()
    assert len(bare) == 2400 and not any(r.good_lost or r.toxic_lost for r in bare)
    assert filter_audit.audit(docs.limit(0), marks).collect() == []


def test_a_very_long_text(spark):
    text = "one two " * 400_000 + "X"
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    row = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'ABCDE' AND step = 2").first()
    assert (row.kept, row.removed, row.unique_fails) == (0, 2, 1)
