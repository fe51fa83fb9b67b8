"""Chat formatting by token-level assembly.

A turn becomes ``[mark of the role] text [end of turn]``. Texts are encoded on their own, and the marks are ids
beyond the vocabulary, so no text can ever contain one. In the written form the marks are control strings;
where a text holds one, or the escape sign, an escape sign goes in front, so writing is reversible as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, ranked_sums

ROLES = ("user", "assistant", "system", "tool")
# Control strings in the order of their reserved ids; a role that is not listed is written out after the fifth.
CONTROLS = ("### User:", "### Assistant:", "### System:", "### Tool:", "### Role:", "</role>", "</turn>")
OTHER, ROLE_END, TURN_END = 4, 5, 6
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@cache
def tokenizer(vocabulary: str):
    """A byte-level encoding that knows no special strings."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(role: str | None, text: str | None, vocabulary: str, first_reserved: int) -> tuple[list[int], list[int]]:
    """Ids and loss mask of a turn: segments side by side, the mask as the running sum of their edges."""
    encode = tokenizer(vocabulary).encode_ordinary
    body = encode(escape(text or ""))
    if role in ROLES:
        head = [first_reserved + ROLES.index(role)]
    else:
        head = [first_reserved + OTHER, *encode(escape(role or "")), first_reserved + ROLE_END]
    ids = [*head, *body, first_reserved + TURN_END]
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    if role == "assistant":
        edges[len(head)] += 1
        edges[len(head) + len(body)] -= 1
    return ids, np.cumsum(edges)[:-1].tolist()


def parse(ids: list[int], mask: list[int], vocabulary: str, first_reserved: int) -> list[tuple[str, str, str, int]]:
    """Turns read back from ids: (role, text, text under the mask, code points of the written form)."""
    decode = tokenizer(vocabulary).decode
    turns, role, held, learned, size = [], None, [], [], 0

    for token, on in zip(ids, mask, strict=True):
        mark = token - first_reserved
        if mark < 0:
            held.append(token)
            if on:
                learned.append(token)
            continue
        written = decode(held)
        size += len(written) + len(CONTROLS[mark])
        if mark == TURN_END:
            turns.append((role, unescape(written), unescape(decode(learned)), size))
            role, learned, size = None, [], 0
        elif mark == ROLE_END:
            role = unescape(written)
        elif mark < len(ROLES):
            role = ROLES[mark]
        held = []
    return turns


def format_chats(
    conversations: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken", first_reserved: int = 50_257, turns_per_part: int = 1024,
) -> DataFrame:
    """One row per turn: ``conversation, turn, ids, mask, start`` (its first token's place in the conversation).

    A conversation may hold a third of all rows, so it is not gathered: turns are encoded where they are, and
    their places are running sums of lengths over parts of ``turns_per_part`` turn numbers, then inside a part.
    Turns are in the order of their number (null first); rows of one number are ordered by role and text. Null
    texts and roles are empty; null conversations are one conversation; an empty table gives an empty result.
    Other columns are not looked at.
    """
    kinds = {c: conversations.schema[n].dataType.simpleString() for c, n in (("conversation", conversation), ("turn", turn))}

    def rows(columns: dict[str, list]):
        for key, at, who, what in zip(*(columns[c] for c in ("conversation", "turn", "role", "text")), strict=True):
            ids, mask = assemble(who, what, vocabulary, first_reserved)
            tie = hashlib.sha256(f"{who or ''}\n{what or ''}".encode("utf-8", "surrogatepass")).digest()[:16]
            yield key, at, ids, mask, len(ids), tie

    plain = conversations.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    schema = f"conversation {kinds['conversation']}, turn {kinds['turn']}, ids array<int>, mask array<int>, length long, tie binary"
    encoded = map_rows(plain, schema, rows)
    part = F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / turns_per_part).cast("long")
    order = [F.asc_nulls_first("turn"), F.asc("tie")]
    return ranked_sums(encoded, ["conversation"], part, order, "length", "start").select("conversation", "turn", "tie", "start", "ids", "mask")


READ_BACK = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chats: DataFrame, *, vocabulary: str = "byte_bpe_50k.tiktoken", first_reserved: int = 50_257) -> DataFrame:
    """Digests of every conversation from its formatted turns.

    Turns are parsed where they are. A digest is a chain over the turns in order, so the last step streams the
    sorted texts of a conversation through one task; it holds a batch, never a conversation.
    """
    kind = chats.schema["conversation"].dataType.simpleString()

    def rows(columns: dict[str, list]):
        names = ("conversation", "start", "ids", "mask")
        for key, start, ids, mask in zip(*(columns[c] for c in names), strict=True):
            for nth, (role, text, learned, size) in enumerate(parse(ids, mask, vocabulary, first_reserved)):
                yield key, start, nth, role, text, learned, size

    parsed = map_rows(
        chats.select("conversation", "start", "ids", "mask"),
        f"conversation {kind}, start long, nth int, role string, text string, learned string, size long",
        rows,
    )
    ordered = parsed.repartition("conversation").sortWithinPartitions("conversation", "start", "nth")
    return ordered.mapInArrow(_digests, READ_BACK.format(kind=kind))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind, at, open_ = None, None, None

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def result() -> tuple:
        n, turns, chars, loss, size = open_
        return at, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        kind, done = batch.schema.field("conversation").type, []
        columns = [batch.column(n).to_pylist() for n in ("conversation", "role", "text", "learned", "size")]
        for key, role, text, learned, size in zip(*columns, strict=True):
            if open_ is None or key != at:
                if open_ is not None:
                    done.append(result())
                at, open_ = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_[0] += 1
            open_[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            open_[2] += len(learned)
            open_[3].update(learned.encode("utf-8", "surrogatepass"))
            open_[4] += size
        yield closed(done)
    if open_ is not None:
        yield closed([result()])
