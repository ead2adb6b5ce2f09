"""Names resolved by their tokens: brute force on small vocabularies, and no pairs from a token that all names have."""

import random

from threadlake.operators import messages as ops


def plain(people, contacts, least=0.7, gap=0.2):
    out = []
    for p in sorted(set(people)):
        a = set(p.split())
        rows = sorted((-len(a & set(n.split())) / len(a | set(n.split())), c) for c, n in contacts if a & set(n.split()))
        if rows and -rows[0][0] >= least and -rows[0][0] - (-rows[1][0] if len(rows) > 1 else 0.0) >= gap:
            out.append((p, rows[0][1], round(-rows[0][0], 6)))
    return out


def test_as_all_pairs(spark):
    r = random.Random(5)
    name = lambda: " ".join(r.sample([*"abcdefghij", "ltd"], r.randint(1, 6)))
    people, contacts = [name() for _ in range(150)] + ["zz", "!"], [(i, name()) for i in range(60)]
    p = spark.createDataFrame([(x,) for x in people], "person string")
    c = spark.createDataFrame(contacts, "contact_id long, name string")
    want = plain([x for x in people if x != "!"], contacts)
    assert len(want) > 10
    assert sorted(tuple(x) for x in ops.fuzzy_names(p, c).collect()) == want


def test_a_common_token_makes_no_pairs(spark):
    n = 20_000
    c = spark.range(n).selectExpr("id AS contact_id", "concat('Supplier#', id) AS name")
    got = ops.fuzzy_names(c.selectExpr("lower(name) AS person"), c)
    assert got.where("person = concat('supplier#', contact_id) AND score = 1").count() == n
