"""Conversations as prefix trees: turns that conversations share at their beginning are written once.

A turn is written as ``[INST]role[SAYS]text[/INST]``, one of the assistant as ``<s>text</s>``. In roles and texts every backslash is
doubled, and control strings get a backslash after their first character, so that none of them is left; both are undone
by reading. Only the text of assistants is under the loss mask.

Conversations are sorted by the path of their turns, and a task walks its range in that order, which is depth-first: a
conversation adds only the turns that its predecessor does not have. A tree is one training sequence, so it ends when
it has ``MAX_CHARS`` characters or ``MAX_LEAVES`` conversations, and the next one begins with the whole path again; a hot
first turn, or one conversation under very many ids, so spreads over sequences and tasks.

Every node has its place in the sequence, its position (the characters of its ancestors, as if they stood right before)
and the intervals of the sequence that it attends to: its ancestors and itself, with touching ones merged.

Turns go by ``turn`` (nulls first), then role and text. Rows without conv_id are one conversation. Null texts and roles are
empty. A conversation of more than ``max_chars`` characters, or one that two tasks hold the turns of, is written in several
pieces: the turns are sorted over all tasks, so that one conversation with a third of all rows spreads like any others. A
later piece is a path of its own, whose positions go on where the piece before ends; its leaf says which piece it is and of
how many, and what it would attend to in the pieces before is all of them. Reading feeds the digests of such a conversation
piece by piece, in one task, for a digest cannot be divided, but with one piece in memory. A turn must fit into memory.
"""

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.storage import materialize

MAX_CHARS, MAX_LEAVES = 1 << 20, 1024
#: Fixed: the control strings of the template.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[SAYS\]")
_TURN = re.compile(r"\[INST\](.*?)\[SAYS\](.*?)\[/INST\]|<s>(.*?)</s>", re.DOTALL)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text under the loss mask lies (start, length; 0, 0 for none)."""
    inside = escape(text)
    if role == ASSISTANT:
        return f"<s>{inside}</s>", 3, len(inside)
    return f"[INST]{escape(role)}[SAYS]{inside}[/INST]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((ASSISTANT, unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


#: Characters of roles and texts that divide the turns among tasks, and bytes of paths (8 a turn).
_KEY_CHARS, _KEY_BYTES = 64, 256
#: What a turn counts beside its role and text.
_TURN_CHARS = 16
_PIECE = "conv_id long, path binary, roles array<string>, texts array<string>, part int, piece int, edge boolean, chars long"
_PIECE_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]


def _assembler(max_chars: int):
    """Sorted turns to pieces of conversations. ``edge`` where the conversation may have other pieces; only there ``chars``."""
    names = [column.split()[0] for column in _PIECE.split(", ")]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], names)

    def assembled(batches):
        part, piece = TaskContext.get().partitionId(), 0
        current, turns, size, done = None, [], 0, []
        edge = True  # the task before may hold the beginning

        def close(is_edge):
            nonlocal turns, size, piece
            key, path = b"", []
            for role, text in turns:
                key = hashlib.blake2b(b"\0".join([key, str(len(role)).encode(), role.encode(), text.encode()]), digest_size=8).digest()
                path.append(key)
            chars = sum(len(format_turn(r, t)[0]) for r, t in turns) if is_edge else 0
            done.append((current, b"".join(path), [r for r, _ in turns], [t for _, t in turns], part, piece, is_edge, chars))
            turns, size, piece = [], 0, piece + 1

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for conv_id, role, text in zip(*(c.slice(start, 1024).to_pylist() for c in batch.columns)):
                    n = len(role) + len(text) + _TURN_CHARS
                    if turns and conv_id != current:
                        close(edge)
                        edge = False
                    elif turns and size + n > max_chars:
                        edge = True
                        close(edge)
                    current = conv_id
                    turns.append((role, text))
                    size += n
                    if len(done) >= 1024 or (done and done[-1][6]):
                        yield emit(done)
                        done.clear()
        if turns:
            close(True)
        if done:
            yield emit(done)

    return assembled


def _pieces(conversations: DataFrame, max_chars: int) -> DataFrame:
    """The pieces of conversations: conv_id, path, roles, texts, piece, of (how many), base (characters before it)."""
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    # in the order of the sort below, but short, as samples of these go through the driver
    short_role = F.length("role") <= _KEY_CHARS
    keys = [F.substring("role", 1, _KEY_CHARS), F.when(short_role, F.substring("text", 1, _KEY_CHARS)).asc_nulls_last()]
    ordered = rows.repartitionByRange("conv_id", "turn", *keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = materialize(ordered.select("conv_id", "role", "text").mapInArrow(_assembler(max_chars), _PIECE), "chat-pieces")
    of_one = Window.partitionBy("conv_id")
    before = of_one.orderBy("part", "piece")
    places = cut.filter("edge").select(
        "part",
        "piece",
        (F.row_number().over(before) - 1).alias("number"),
        F.count(F.lit(1)).over(of_one).alias("of"),
        F.coalesce(F.sum("chars").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    columns = ["conv_id", "path", "roles", "texts"]
    whole = cut.filter("NOT edge").select(*columns, F.lit(0).alias("piece"), F.lit(1).cast("long").alias("of"), F.lit(0).cast("long").alias("base"))
    pieces = cut.filter("edge").join(places, ["part", "piece"]).select(*columns, F.col("number").alias("piece"), "of", "base")
    return whole.unionByName(pieces)


class Tree:
    """One sequence under construction."""

    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.turns: list[tuple[str, str]] = []
        self.base = 0
        self.leaves: list[dict] = []

    def shared(self, turns: list[tuple[str, str]], base: int = 0) -> int:
        """Turns that are there already; none of a piece that is not the first."""
        n = 0
        while not (base or self.base) and n < min(len(turns), len(self.turns)) and turns[n] == self.turns[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], piece: int = 0, of: int = 1, base: int = 0) -> None:
        n = self.shared(turns, base)
        self.stack = self.stack[:n]
        for role, text in turns[n:]:
            written, loss_start, loss_length = format_turn(role, text)
            parent = self.stack[-1] if self.stack else -1
            own = [self.size, self.size + len(written)]
            above = self.nodes[parent] if self.stack else {"position": base, "length": 0, "attends": []}
            attends = above["attends"]
            attends = [*attends[:-1], own[1]] if attends and attends[-1] == own[0] else [*attends, *own]
            self.stack.append(len(self.nodes))
            self.nodes.append(
                {
                    "parent": parent,
                    "start": own[0],
                    "length": len(written),
                    "position": above["position"] + above["length"],
                    "loss_start": own[0] + loss_start,
                    "loss_length": loss_length,
                    "attends": attends,
                }
            )
            self.text.append(written)
            self.size = own[1]
        self.turns, self.base = turns, base
        self.leaves.append({"conv_id": conv_id, "node": self.stack[-1], "piece": piece, "of": of})


_NODE = ["parent", "start", "length", "position", "loss_start", "loss_length"]
_NODE_TYPE = pa.struct([*((n, pa.int64()) for n in _NODE), ("attends", pa.list_(pa.int64()))])
_LEAF = ["conv_id", "node", "piece", "of"]
_LEAF_TYPE = pa.struct([(n, pa.int64()) for n in _LEAF])
_TREE_SCHEMA = (
    "text string, nodes array<struct<" + ", ".join(f"{n}: bigint" for n in _NODE) + ", attends: array<bigint>>>, "
    "leaves array<struct<" + ", ".join(f"{n}: bigint" for n in _LEAF) + ">>"
)


def prefix_trees(conversations: DataFrame, max_chars: int = MAX_CHARS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """Training sequences: text, nodes (parent, start, length, position, loss span, attended intervals), leaves."""
    def grow(batches):
        def emit(tree):
            columns = [pa.array(["".join(tree.text)]), pa.array([tree.nodes], pa.list_(_NODE_TYPE)), pa.array([tree.leaves], pa.list_(_LEAF_TYPE))]
            return pa.RecordBatch.from_arrays(columns, ["text", "nodes", "leaves"])

        tree = Tree()
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                for conv_id, roles, texts, piece, of, base in zip(*(c.slice(start, 16).to_pylist() for c in batch.columns)):
                    turns = list(zip(roles, texts))
                    new = sum(len(r) + len(t) for r, t in turns[tree.shared(turns, base) :])
                    if tree.leaves and (tree.size + new > max_chars or len(tree.leaves) >= max_leaves):
                        yield emit(tree)
                        tree = Tree()
                    tree.add(conv_id, turns, piece, of, base)
        if tree.leaves:
            yield emit(tree)

    spread = _pieces(conversations, max_chars).repartitionByRange(F.substring("path", 1, _KEY_BYTES), "conv_id", "piece")
    walk = spread.sortWithinPartitions("path", "conv_id", "piece").select("conv_id", "roles", "texts", "piece", "of", "base")
    return walk.mapInArrow(grow, _TREE_SCHEMA)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PART = "conv_id long, piece long, n_turns long, turns binary, said string, formatted_chars long"
_READ_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]


def _batch(rows, schema: str, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])


def read_trees(trees: DataFrame) -> DataFrame:
    """Every conversation, from what its leaf attends to and the loss mask on its path.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    def said_in(text, nodes, leaf):
        """Number of turns, what is digested of them, the text under the loss mask, characters."""
        attends = nodes[leaf["node"]]["attends"]
        formatted = "".join(text[a:b] for a, b in zip(attends[::2], attends[1::2]))
        found = parse(formatted)
        loss, at = [], leaf["node"]
        while at >= 0:
            node = nodes[at]
            loss.append(unescape(text[node["loss_start"] : node["loss_start"] + node["loss_length"]]))
            at = node["parent"]
        turns = "".join(f"{role}\n{said}\n" for role, said in found).encode()
        return len(found), turns, "".join(reversed(loss)), len(formatted)

    def of_trees(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield [c.slice(i, 1).to_pylist()[0] for c in batch.columns]

    def whole(batches):
        for text, nodes, leaves in of_trees(batches):
            rows = []
            for leaf in leaves:
                if leaf["of"] == 1:
                    n, turns, said, chars = said_in(text, nodes, leaf)
                    rows.append((leaf["conv_id"], n, hashlib.sha256(turns).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), chars))
            if rows:
                yield _batch(rows, _READ, _READ_TYPES)

    def parts(batches):
        for text, nodes, leaves in of_trees(batches):
            for leaf in leaves:
                if leaf["of"] > 1:
                    yield _batch([(leaf["conv_id"], leaf["piece"], *said_in(text, nodes, leaf))], _PART, _PART_TYPES)

    def joined(batches):
        """Sorted pieces to conversations; only the digests are kept from piece to piece."""
        current, state = None, None

        def row():
            n, turns, loss_chars, loss, chars = state
            return _batch([(current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], _READ, _READ_TYPES)

        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, _, n, turns, said, chars = (c[i].as_py() for c in batch.columns)
                if state and conv_id != current:
                    yield row()
                    state = None
                current, state = conv_id, state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += len(said)
                state[3].update(said.encode())
                state[4] += chars
        if state:
            yield row()

    divided = trees.filter(F.exists("leaves", lambda leaf: leaf["of"] > 1)).mapInArrow(parts, _PART)
    in_order = divided.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return trees.mapInArrow(whole, _READ).unionByName(in_order.mapInArrow(joined, _READ))


def write_and_read(conversations: DataFrame) -> DataFrame:
    """The trees, written as a table, and what is read back from it."""
    return read_trees(materialize(prefix_trees(conversations), "chat-trees"))
