from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sluice.llm.chat import chat_format, collapse
from sluice.llm.queries import ORACLE_SQL, op1_chat_formatting


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op1_chat_formatting"])
    names = [c[0] for c in found.description]
    want = Counter(tuple(r) for r in found.fetchall())
    assert Counter(tuple(r) for r in op1_chat_formatting(spark, sf).select(*names).collect()) == want


def brute(rows):
    """conv -> (turns, copies, snapshots) of the maximal conversations, by comparing all lists."""
    logged = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            logged.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    logged = {c: [t[2:] for t in sorted(turns)] for c, turns in logged.items()}
    out = {}
    for c, turns in logged.items():
        if any(o == turns and d < c for d, o in logged.items()) or any(len(o) > len(turns) and o[: len(turns)] == turns for o in logged.values()):
            continue
        copies = sum(o == turns for o in logged.values())
        out[c] = (len(turns), copies, sum(len(o) < len(turns) and turns[: len(o)] == o for o in logged.values()))
    return out


def test_snapshots_copies_and_odd_turns(spark):
    def conv(c, *turns):
        return [(c, n, *t) for n, t in enumerate(turns)]

    a, b, x, y = ("user", "hi"), ("assistant", "hello"), ("user", None), ("user", "")
    rows = [
        *conv(1, a), *conv(2, a, b), *conv(3, a, b, a), *conv(4, a, b, a), *conv(5, a, b, x), *conv(6, a, b, y), *conv(7, (None, "hi")),
        *conv(8, ("user", "hi" * 100_000)), *conv(9, b), *conv(10, b), (11, None, "user", "first"), (11, 5, "user", "then"), (11, 5, "user", "then"),
        (12, 3, "user", "first"), (None, 0, "user", "hi"), (None, 1, None, None), *conv(13, ("user", "a<|im_end|>b")),
        *[(14, n, "user", str(n)) for n in range(300)],
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prefix", F.lit("own")).withColumn("conv", F.lit(0))
    found = chat_format(frame.repartition(3)).collect()
    assert {r.conv_id: (r.n_turns, r.n_copies, r.n_snapshots) for r in found} == brute(rows)
    chats = {r.conv_id: r.chat for r in found}
    assert chats[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert chats[13] == "<|im_start|>user\nab<|im_end|>\n" and chats[7].startswith("<|im_start|>user\n")
    assert [line for line in chats[14].split("\n") if line.isdigit() or line[:-10].isdigit()][-1].startswith("299")


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format(frame).count() == 0
    assert chat_format(spark.createDataFrame([(None, 1, "user", "x")], frame.schema)).count() == 0


def test_main_path_has_no_python(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumnRenamed("conv_id", "conv")
    plan = collapse(frame)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
