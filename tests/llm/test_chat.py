import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.llm import chat

from .conftest import words

ROWS = "conv_id long, turn long, role string, text string, path string, node long"
pieces = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SAYS]", "\\", "<", "[", "s>", "/", "a", "\n", "é", "INST]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(pieces, st.just("assistant")), pieces), min_size=1, max_size=4))
def test_template_round_trip(turns):
    written = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse("".join(w for w, _, _ in written)) == turns
    for (_, text), (w, start, n) in zip(turns, written):
        inside = chat.escape(text)
        assert not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SAYS]"))
        assert n == 0 or chat.unescape(w[start : start + n]) == text


def conversation_rows():
    rng = random.Random(8)
    first, rows = words(rng, 12), []
    for c in range(120):
        turns = [("user", first if c % 3 else words(rng, 5))] + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no </s>", words(rng, 4)])) for _ in range(rng.randint(0, 5))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    for c in range(200, 260):
        rows += [(c, 0, "user", "hot"), (c, 1, "assistant", "same")]
    rows += [(300, None, None, None), (300, 1, "assistant", None), (301, 0, "assistant", ""), (302, 5, "user", words(rng, 20_000)), (302, 9, "assistant", "x")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "[INST]"), (303, 0, "user", "tie b"), (303, 0, "user", "tie a"), (304, 0, "user", "twice"), (304, 0, "user", "twice")]
    return [(*r, "x", 1) for r in rows]


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[c, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat.format_turn(r, t)[0]) for r, t in turns)] += 1
    return out


@pytest.mark.parametrize("max_chars, max_leaves", [(chat.MAX_CHARS, chat.MAX_LEAVES), (500, 1000), (10**9, 3)])
def test_read_back_against_brute_force(spark, max_chars, max_leaves):
    df = spark.createDataFrame(conversation_rows(), ROWS).repartition(4)
    trees = chat.prefix_trees(df, max_chars, max_leaves)
    assert Counter(tuple(r) for r in chat.read_trees(trees).collect()) == brute(conversation_rows())


def test_shared_turns_are_written_once_depth_first(spark):
    rows = [(c, i, r, t, "", 0) for c, turns in enumerate([["q", "a", "b"], ["q", "a", "c"], ["q", "d"], ["z"]]) for i, (r, t) in enumerate(zip(["user", "assistant", "user"], turns))]
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        (tree,) = chat.prefix_trees(spark.createDataFrame(rows, ROWS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(tree.nodes) == 6 and len(tree.leaves) == 4
    assert sum(n.length for n in tree.nodes) == len(tree.text)
    ends = 0
    for i, n in enumerate(tree.nodes):
        assert n.start == ends and n.parent < i
        ends += n.length
        above, at = [], n.parent
        while at >= 0:
            above.append(tree.nodes[at])
            at = tree.nodes[at].parent
        assert n.position == sum(a.length for a in above)
        spans = list(zip(n.attends[::2], n.attends[1::2]))
        assert sum(b - a for a, b in spans) == n.position + n.length and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        covered = {k for a, b in spans for k in range(a, b)}
        assert covered == {k for m in [n, *above] for k in range(m.start, m.start + m.length)}


def test_a_conversation_with_most_rows_is_divided(spark):
    """Also the one of all rows without conv_id; the pieces go on where the one before ends."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), words(rng, rng.randint(0, 8)), "", 0) for c in (None, 5) for t in range(3000)]
    rows += [(c, t, "user", "short", "", 0) for c in (1, 9) for t in range(3)] + [(5, 7, "r" * 200, t, "", 0) for t in ("b", "a", "")]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    trees = chat.materialize(chat.prefix_trees(df, max_chars=5000), "test-trees")
    assert Counter(tuple(r) for r in chat.read_trees(trees).collect()) == brute(rows)
    pieces = defaultdict(dict)
    for tree in trees.collect():
        assert len(tree.text) < 3 * 5000
        for leaf in tree.leaves:
            node = tree.nodes[leaf.node]
            first = node
            while first.parent >= 0:
                first = tree.nodes[first.parent]
            pieces[leaf.conv_id, leaf.of][leaf.piece] = first.position, node.position + node.length
    for (conv_id, of), found in pieces.items():
        assert sorted(found) == list(range(of)) and (of > 10) == (conv_id in (None, 5))
        spans = [found[i] for i in range(of)]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_clashing_names(spark):
    names = "path roles texts part piece edge chars of base number leaves nodes".split()
    df = spark.createDataFrame([r[:4] for r in conversation_rows()], "conv_id long, turn long, role string, text string").withColumns({n: chat.F.lit("x") for n in names})
    assert Counter(tuple(r) for r in chat.write_and_read(df).collect()) == brute(conversation_rows())


def test_empty(spark):
    assert chat.write_and_read(spark.createDataFrame([], ROWS)).count() == 0
