"""The audit against a brute-force version that runs every order over the documents."""

import re
from collections import Counter
from itertools import permutations

from sluice.llm import audit
from sluice.llm.queries import op13_filter_audit

SF = "/root/testdata/sf0.001"


def failures(rows):
    """(part, set of failed filters, doc_id) of each row (doc_id, text, part)."""
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words, own = re.findall(r"[^\x20\x09-\x0D]+", text), set()
        if len(words) < 100:
            own.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            own.add("C")
        if set(text) & set("#$%&*|"):
            own.add("D")
        if any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, t, _ in rows):
            own.add("E")
        out.append((part or "", own, doc_id))
    return out


def brute_force(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    judged = failures(rows)
    out, removed_by = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = judged
        for step, f in enumerate(order, 1):
            for part in {p for p, _, _ in judged}:
                fails = [own for p, own, _ in judged if p == part and f in own]
                lost = [i for p, own, i in left if p == part and f in own]
                kept = sum(p == part and f not in own for p, own, _ in left)
                removed_by[part, f] += len(lost)
                alone = sum(own == {f} for own in fails)
                out[part, order, step] = (kept, len(lost), len(fails) - len(lost), alone, sum(i in good for i in lost), sum(i in toxic for i in lost))
            left = [r for r in left if f not in r[1]]
    return Counter((*key, *values, removed_by[key[0], key[1][key[2] - 1]]) for key, values in out.items())


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text, r.lang) for r in table("documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table("labels").collect()]
    found = op13_filter_audit(spark, SF)
    assert found.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert Counter(map(tuple, found.collect())) == brute_force(rows, labels)


def test_odd_rows(spark, odd, nothing):
    labels = [(1, 1, 0), (1, 0, 1), (1, None, None), (None, 1, 1), (10, 0, 1), (7, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert Counter(map(tuple, audit.audit(odd, marks, part="source").collect())) == brute_force(rows, labels)
    assert audit.audit(nothing, marks).count() == 0
    assert audit.audit(odd, marks.where("false")).count() == 600


def test_filters_at_their_limits(spark):
    texts = ["", " ", "a", " a b ", "\n" + " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i}" for i in range(100)), "x " * 100]
    texts += [" ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "ABCDEFGHIJ" + "é" * 90, "ABCDEFGHIJK" + "é" * 89]
    texts += [*"#$%&*|", "Ä", "A B", "same", "same", None]
    rows = [(i, t, "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: {f for f in "ABCDE" if r[f]} for r in audit.judge(docs).collect()}
    assert found == {i: own for _, own, i in failures(rows)}
