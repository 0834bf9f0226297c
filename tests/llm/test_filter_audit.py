"""The filter audit against a plain loop over documents, orders and steps."""

import re
from collections import Counter
from itertools import permutations

import pytest
from odd import ODD

from linkfold.llm import filter_audit


def _plain(rows, labels):
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = ""
        own += "A" if len(words) < 200 else ""
        own += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        own += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        own += "D" if re.search("[#$%&*|]", text) else ""
        own += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else ""
        good, toxic = (any(a == i and q[k] == 1 for a, *q in labels if i is not None) for k in (0, 1))
        fails.append((lang or "", own, good, toxic))
    out, total = [], Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                hit = [f for f in left if x in f[1]]
                every = [f for f in fails if f[0] == part and x in f[1]]
                left = [f for f in left if x not in f[1]]
                out.append((part, "".join(order), step, len(left), len(hit), len(every) - len(hit), sum(f[1] == x for f in every), sum(f[2] for f in hit), sum(f[3] for f in hit)))
                total[part, x] += len(hit)
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def _run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, "x", "x", "x") for i, t, g in rows], "doc_id long, text string, lang string, part string, mask string, digest string")
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, told).drop("letter")
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(map(tuple, got.collect()))


def _rows(prose):
    long = [prose(260, k) for k in range(6)]
    texts = [*long, *long[:3], long[0], long[1] + " $", long[2].upper(), "w " * 300, "W " * 300, *ODD, "", None, long[0]]
    return [(k if k % 9 else k // 2, t, [None, "", "en", "de"][k % 4]) for k, t in enumerate(texts)]


@pytest.mark.parametrize("parts", [filter_audit.PARTS, 1])
def test_against_a_plain_loop(spark, prose, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "PARTS", parts)
    rows = _rows(prose)
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (4, rows[4][1], rows[4][2]), (4, rows[4][1], "fr"), (4, "other", "en"), (99, "x|y", None)]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(20)] + [(3, None, 1), (4, 0, 0), (4, 1, None), (None, 1, 1), (500, 1, 1)]
    assert _run(spark, rows, labels) == _plain(rows, labels)


def test_no_documents_and_no_labels(spark):
    assert _run(spark, [], [(1, 1, 1)]) == []
    got = _run(spark, [(1, None, None)], [])
    assert got == _plain([(1, None, None)], []) and len(got) == 600
