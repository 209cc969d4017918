from gridloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    c = {}
    for d, t, r, x in set(rows):
        c.setdefault(d, []).append((t is not None, t or 0, r or "", x or ""))
    c = {d: [(r, x) for _, _, r, x in sorted(v)] for d, v in c.items()}
    top = [d for d, v in c.items() if not any(len(w) > len(v) and w[: len(v)] == v for w in c.values())]
    least = {}
    for d in sorted(top, key=lambda d: (d is not None, d or 0)):
        least.setdefault(tuple(c[d]), d)
    return sorted((str(d), len(v), sum(w == list(v) for w in c.values()), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)) for v, d in least.items())


def got(df):
    return sorted((str(r.conv_id), r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect())


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(c, t, *full[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", None), (8, 5, None, ""), (8, None, "user", "x")]
    rows += [(None, 0, "user", "lost"), (3, 0, "user", "hi"), (10, 0, "user", "long " * 9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.selectExpr("*", "1 as n", "2 as c", "3 as h", "4 as n_turns")) == brute(rows)
    assert chat.render(df.limit(0)).count() == 0
    ties = [(c, 1, "user", x) for c, xs in ((1, "ab"), (2, "ba")) for x in xs]
    assert [r.n_copies for r in chat.render(spark.createDataFrame(ties, SCHEMA)).collect()] == [2]


def test_real_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def test_least_long_is_an_id_like_any_other(spark):
    rows = [(-(2**63), 0, "user", "a"), (-(2**63), 1, "user", "b"), (None, 0, "user", "c"), (2**63 - 1, 0, "user", "d"), (None, 1, "user", "e")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
