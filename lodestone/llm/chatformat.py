"""Chat formatting with shared turns emitted once.

Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles a
backslash is put after each ``<`` that, over any backslashes, a ``|`` follows, so no text holds a
control string and the original can be told.

Conversations are sorted by the hashes of their turns over all partitions, which puts those
with equal first turns side by side however many there are; no task needs a whole tree.
A task walks its part in order and grows prefix trees: each turn is emitted once, depth
first, with the position of its first token in its conversation and the intervals of the
sequence that it may attend to, its ancestors'.  A tree that reaches the size limit, or the end of
a part, ends its sequence; the next one repeats the turns that lead to it.

A conversation of very many turns or characters is never gathered: its turns are sorted over all partitions and
cut into parts of bounded size, each a path of its own, which its leaf numbers.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise
from lodestone.llm.tokens import byte_bpe

MAX_TOKENS = 1 << 16
MAX_TURNS, MAX_CHARS = 1 << 12, 1 << 22  # of a conversation, or part of one, that is one row
START, END = "<|im_start|>", "<|im_end|>"
SEQUENCES = (
    "sequence_id long, ids array<int>, segments array<struct<start: int, length: int, position: int, parent: int, loss_start: int, loss_length: int, "
    "attends: array<struct<from: int, to: int>>>>, leaves array<struct<conv_id: long, part: long, segment: int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and without line feeds, which end a role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` of each turn of a formatted conversation."""
    turns = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.S)
    return [(unescape_role(r), unescape(t)) for r, t in turns]


class Tree:
    """One sequence in the making."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.turns: list[tuple[str, str]] = []  # by segment
        self.segments: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[int] = []  # segments of the conversation added last

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.turns[self.path[n]] == turns[n]:
            n += 1
        return n

    def add(self, conv_id, part, turns: list[tuple[str, str]], coded: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]], train: str) -> None:
        n = self.shared(turns)
        del self.path[n:]
        for turn in turns[n:]:
            head, body, foot = coded[turn]
            parent = self.path[-1] if self.path else -1
            length = len(head) + len(body) + len(foot)
            up = self.segments[parent] if self.path else None
            attends = [dict(a) for a in up["attends"]] if up else []
            if up and attends and attends[-1]["to"] == up["start"]:
                attends[-1]["to"] = up["start"] + up["length"]
            elif up:
                attends.append({"from": up["start"], "to": up["start"] + up["length"]})
            loss = (self.size + len(head), len(body)) if turn[0] == train else (0, 0)
            self.segments.append({"start": self.size, "length": length, "position": up["position"] + up["length"] if up else 0, "parent": parent, "loss_start": loss[0], "loss_length": loss[1], "attends": attends})
            self.ids += [head, body, foot]
            self.size += length
            self.turns.append(turn)
            self.path.append(len(self.segments) - 1)
        self.leaves.append({"conv_id": conv_id, "part": part, "segment": self.path[-1]})

    def row(self, sequence_id: int) -> pd.DataFrame:
        return pd.DataFrame({"sequence_id": [sequence_id], "ids": [np.concatenate(self.ids)], "segments": [self.segments], "leaves": [self.leaves]})


def format_conversations(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train: str = "assistant", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Sequences of token ids: ``sequence_id, ids, segments, leaves``.

    A segment is a turn: its first token and length in ``ids``, the position id of its first token (the
    others follow), its parent segment (-1: none), the interval under the loss mask (texts of
    role ``train``; else length 0) and the intervals it attends to besides its own earlier
    tokens.  A leaf names a conversation and its last segment.  Where a conversation has more than MAX_TURNS turns or
    MAX_CHARS characters it has several leaves, whose ``part`` gives their order (else null); positions begin anew in each.

    Null roles and texts are empty.  Turns are taken in order of (turn, role, text), so repeated rows are turns of
    their own; a null turn number comes first and a null conversation id is one conversation.  Columns other than those named are
    not read.  An empty table gives no rows.
    """
    by_turn = turns.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chars = F.char_length("t.role") + F.char_length("t.text")
    long_ = materialise(by_turn.groupBy("conv").agg(F.count("*").alias("n"), F.sum(chars).alias("size")).where((F.col("n") > MAX_TURNS) | (F.col("size") > MAX_CHARS)).select(F.col("conv").alias("_long")))
    gather = lambda rows, *keys: rows.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    if long_.isEmpty():
        whole = gather(by_turn, "conv").withColumn("part", F.lit(None).cast("long"))
    else:
        same = F.col("conv").eqNullSafe(F.col("_long"))
        whole = gather(by_turn.join(long_, same, "left_anti"), "conv").withColumn("part", F.lit(None).cast("long"))
        whole = whole.unionByName(gather(_parts(by_turn.join(long_, same, "left_semi")), "conv", "part"))
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, tree, n = byte_bpe(tokenizer), Tree(), TaskContext.get().partitionId() << 32
        for b in batches:
            talks = [[(t["role"], t["text"]) for t in turns] for turns in b["turns"]]
            coded = _coded(bpe, list(dict.fromkeys(t for turns in talks for t in turns)))  # each turn of a batch once
            for conv, part, turns in zip(b["conv"].tolist(), b["part"].tolist(), talks, strict=True):
                fresh = turns[tree.shared(turns) :]
                if tree.leaves and tree.size + sum(len(x) for t in fresh for x in coded[t]) > max_tokens:
                    yield tree.row(n)
                    tree, n = Tree(), n + 1
                tree.add(None if pd.isna(conv) else int(conv), None if pd.isna(part) else int(part), turns, coded, train)
        if tree.leaves:
            yield tree.row(n)

    dealt = whole.repartitionByRange("path", "conv", "part").sortWithinPartitions("path", "conv", "part").select("conv", "part", "turns")
    return dealt.mapInPandas(grow, SEQUENCES)


def _parts(turns: DataFrame) -> DataFrame:
    """``conv, part, t``: the turns of long conversations, sorted over all partitions and numbered by parts of at most
    MAX_TURNS turns and about MAX_CHARS characters; a part ends with its partition, too."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, size, last = (TaskContext.get().partitionId() << 32) - 1, 0, 0, object()
        for b in batches:
            out = []
            for conv, chars in zip(b["conv"].astype(object).where(b["conv"].notna(), None), b["chars"].tolist(), strict=True):
                if conv != last or n >= MAX_TURNS or size + chars > MAX_CHARS:
                    part, n, size, last = part + 1, 0, 0, conv
                n, size = n + 1, size + chars
                out.append(part)
            yield b.drop(columns="chars").assign(conv=b["conv"].astype("Int64"), turn=b["turn"].astype("Int64"), part=out)

    # Repeated turns of one conversation are told apart by their place, so that no value fills a partition.
    rows = turns.select("conv", "t.*", (F.char_length("t.role") + F.char_length("t.text")).alias("chars"), F.monotonically_increasing_id().alias("_at"))
    order = ["conv", "turn", "role", "text", "_at"]
    dealt = materialise(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
    numbered = dealt.mapInPandas(number, "conv long, turn long, role string, text string, part long")
    return materialise(numbered).select("conv", "part", F.struct("turn", "role", "text").alias("t"))


def _coded(bpe, turns: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ids of head, text and end of each turn."""
    parts = [p for role, text in turns for p in (f"{START}{escape_role(role)}\n", escape(text), f"{END}\n")]
    ids = bpe.encode(parts)
    return dict(zip(turns, zip(ids[0::3], ids[1::3], ids[2::3], strict=True), strict=True))


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose tokens write a byte as a
    printable character: itself, or from 256 on in order of byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    tokenizer = byte_bpe(path).tokenizer
    return [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) if all(c in byte_of for c in tokenizer.id_to_token(i)) else b"" for i in range(tokenizer.get_vocab_size())]


def read_conversations(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """The conversations in ``sequences``, or parts of long ones: ``conv_id, part, formatted, loss_text, turns``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = token_bytes(tokenizer)
        for b in batches:
            for ids, segments, leaves in zip(b["ids"], b["segments"], b["leaves"], strict=True):
                ids = ids.tolist()
                text = lambda a, n: b"".join([table[i] for i in ids[a : a + n]]).decode("utf-8", "surrogatepass")  # noqa: E731, B023
                whole = [text(s["start"], s["length"]) for s in segments]
                loss = [unescape(text(s["loss_start"], s["loss_length"])) for s in segments]
                rows = []
                for leaf in leaves:
                    path, at = [], leaf["segment"]
                    while at >= 0:
                        path.append(at)
                        at = segments[at]["parent"]
                    formatted = "".join(whole[s] for s in reversed(path))
                    rows.append((leaf["conv_id"], leaf["part"], formatted, "".join(loss[s] for s in reversed(path)), [{"role": r, "text": t} for r, t in parse(formatted)]))
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "part", "formatted", "loss_text", "turns"])
        return out.assign(**{name: pd.array([None if pd.isna(c) else int(c) for c in out[name]], dtype="Int64") for name in ("conv_id", "part")})

    return sequences.select("ids", "segments", "leaves").mapInPandas(read, "conv_id long, part long, formatted string, loss_text string, turns array<struct<role: string, text: string>>")


def digests(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation read back from ``sequences``: ``conv_id, n_turns, turns_sha256`` (role, line feed, text and line feed of each
    turn), ``loss_chars, loss_sha256, formatted_chars``.  Parts are taken in order by one running hash, never put together."""
    sequences = materialise(sequences)
    with_parts = sequences.where(F.exists("leaves", lambda leaf: leaf["part"].isNotNull()))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    count = [F.size("turns").cast("long").alias("n_turns"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.char_length("formatted").cast("long").alias("formatted_chars")]
    whole = read_conversations(sequences, tokenizer).where("part IS NULL").select("conv_id", *count, F.sha2(said, 256).alias("turns_sha256"), F.sha2("loss_text", 256).alias("loss_sha256"))
    parts = read_conversations(with_parts, tokenizer).where("part IS NOT NULL").select("conv_id", "part", *count, said.alias("said"), F.col("loss_text").alias("loss"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, conv = None, None
        for b in batches:
            done = []
            for row in b.itertuples(index=False):
                name = None if pd.isna(row.conv_id) else int(row.conv_id)
                if sums is None or name != conv:
                    done += [_summed(conv, sums)] if sums else []
                    sums, conv = [0, 0, 0, hashlib.sha256(), hashlib.sha256()], name
                for k, v in enumerate((row.n_turns, row.loss_chars, row.formatted_chars)):
                    sums[k] += v
                sums[3].update(row.said.encode("utf-8", "surrogatepass"))
                sums[4].update(row.loss.encode("utf-8", "surrogatepass"))
            yield _summary(done)
        if sums:
            yield _summary([_summed(conv, sums)])

    def _summed(conv: int | None, sums: list) -> tuple:
        return conv, *sums[:3], sums[3].hexdigest(), sums[4].hexdigest()

    def _summary(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256"])
        return out.assign(conv_id=pd.array(out["conv_id"].tolist(), dtype="Int64"))

    long_ = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(long_.mapInPandas(walk, "conv_id long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string"))
