import hashlib

import pytest

from lamella.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes, fanout):
    """Root, and each node's siblings by level, one level at a time."""
    paths, level = [[] for _ in nodes], list(nodes)
    places = list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(places):
            first = i // fanout * fanout
            paths[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        places = [i // fanout for i in places]
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout):
    groups = {}
    for doc_id, source, leaf in rows:
        groups.setdefault((source is not None, (source or "").encode(), source), []).append((doc_id is not None, doc_id or 0, doc_id, leaf))
    trees = {g: plain_tree([x[3] for x in sorted(members)], fanout) for g, members in sorted(groups.items())}
    root, upper = plain_tree([t[0] for t in trees.values()], fanout)
    out = []
    for (g, members), up in zip(sorted(groups.items()), upper, strict=True):
        for x, path in zip(sorted(members), trees[g][1], strict=True):
            out.append((x[2], x[3], trees[g][0], root, path + up))
    return out


@pytest.mark.parametrize(("fanout", "levels"), [(3, 6), (3, 2)])
def test_proofs_are_those_of_plain_trees(spark, fanout, levels):
    sizes = {None: 30, "": 1, "a": 9, "b": 10, "hot": 400, "é": 2, "z": 1}
    rows = [(i * 7 % 1000 + 1000 * k, g, h(str(i), str(g))) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, leaf string, i string").repartition(7)
    got = manifest.manifest(df, fanout=fanout, levels=levels).collect()
    want = plain(rows, fanout)
    assert sorted((r.id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got) == sorted(want)
    for r in got:
        assert r.folded_root == r.root
        assert r.proof_sha256 == h(*(x for p in r.proof for x in p))


def test_leaves_and_claims(spark):
    docs = [(1, "s", None, 3, "a\nb"), (2, "s", "de", None, "ü"), (3, None, "de", 0, ""), (None, "s", "x", 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    fields = [df[f] for f in manifest.FIELDS]
    leaves = df.select("doc_id", "source", manifest.leaf(*fields).alias("leaf"))
    assert {r.leaf for r in leaves.collect()} == {h(*map(written, d)) for d in docs}
    got = {r.id: r for r in manifest.manifest(leaves.selectExpr("*", "CASE WHEN doc_id = 2 THEN sha2('other', 256) WHEN doc_id = 1 THEN leaf END AS claim"), claim="claim").collect()}
    assert {k: r.folded_root == r.root for k, r in got.items()} == {1: True, 2: False, 3: True, None: True}
    assert manifest.folded(h("other"), [tuple(p) for p in got[2].proof]) == got[2].folded_root


def test_small_tables(spark):
    schema = "doc_id long, source string, leaf string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    (one,) = manifest.manifest(spark.createDataFrame([(5, None, "f")], schema)).collect()
    assert (one.leaf, one.subroot, one.root, one.folded_root, one.proof, one.proof_sha256) == ("f", "f", "f", "f", [], h())
    same = manifest.manifest(spark.createDataFrame([(1, "a", "f")] * 5, schema)).collect()
    assert {(r.root, r.folded_root == r.root) for r in same} == {(plain_tree(["f"] * 5, 3)[0], True)}
    assert len(same) == 5
