"""Op 4. Edit-aware token counts.

A document's count is kept as a segment tree over blocks of its text. Blocks are cut before a space
that stands between two other characters, where no pre-token can cross, so a block's ids don't depend
on its neighbours. An edit finds its blocks by descending the subtree sums of characters, takes one
block of context on either side (so the outer cuts keep their surroundings), encodes that stretch
again, and updates the sums on the paths to the root. The rest of the text is not looked at.

Edge cases: a null or empty text has a tree of one empty block; an edit's place and length are clipped to
the text as it is then; a text without a place to cut is one block; null edits change nothing; repeated
rows are counted each; an empty table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import read, slices

BLOCK = 400


def blocks_of(text: str, size: int = BLOCK) -> list[str]:
    """The text in pieces of about ``size`` characters, each cut before a lone space."""
    out, begin, n = [], 0, len(text)
    at = text.find(" ", size)
    while at > 0:
        if at + 1 < n and not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(text[begin:at])
            begin = at
            at = text.find(" ", begin + size)
        else:
            at = text.find(" ", at + 1)
    out.append(text[begin:])
    return out


class TokenTree:
    """Characters and tokens of a text, by block, with subtree sums."""

    def __init__(self, text: str, words):
        self.words = words
        self.blocks = blocks_of(text)
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, block in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = len(block), self._count(block)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded_chars = 0

    def _count(self, block: str) -> int:
        return len(self.words.encode(block)) // 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (at the end: the last that has any), and the place in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _set(self, i: int, block: str, tokens: int) -> None:
        self.blocks[i] = block
        node = self.width + i
        self.chars[node], self.tokens[node] = len(block), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _beside(self, i: int, step: int) -> int:
        """The nearest block that isn't empty on that side of i; i if there is none."""
        j = i + step
        while 0 <= j < len(self.blocks):
            if self.blocks[j]:
                return j
            j += step
        return i

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        at = min(max(0, at), self.n_chars)
        deleted = min(max(0, deleted), self.n_chars - at)
        first, offset = self.find(at)
        last = self.find(at + deleted)[0]
        left, right = self._beside(first, -1), self._beside(last, 1)
        # one character of a block is no context: the cut after it looks at both of its neighbours
        while len(self.blocks[left]) < 2 and (more := self._beside(left, -1)) != left:
            left = more
        while len(self.blocks[right]) < 2 and (more := self._beside(right, 1)) != right:
            right = more
        offset += sum(len(self.blocks[i]) for i in range(left, first))
        stretch = "".join(self.blocks[left : right + 1])
        stretch = stretch[:offset] + inserted + stretch[offset + deleted :]
        self.encoded_chars += len(stretch)
        # as many blocks as before take the new stretch, where it can be cut
        pieces = blocks_of(stretch, max(BLOCK, -(-len(stretch) // (right - left + 1))))
        room = right - left + 1
        if len(pieces) > room:
            pieces = [*pieces[: room - 1], "".join(pieces[room - 1 :])]
        for k in range(room):
            block = pieces[k] if k < len(pieces) else ""
            self._set(left + k, block, self._count(block))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("edited_tokens", pa.int64()), ("edited_chars", pa.int64()), ("edited_crc32", pa.int64()), ("encoded_chars", pa.int64())])


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokens of each text (doc_id, text) before and after its ``edits``, an array of (at, deleted, inserted) made in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hdulake.llm.tokens import encoder

        words = encoder(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text, edits in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "edits")), strict=True):
                tree = TokenTree(text or "", words)
                before, edits = tree.n_tokens, [e for e in edits or [] if e is not None]
                for e in edits:
                    tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                edited = tree.text().encode("utf-8", "surrogatepass")
                rows.append((doc_id, before, len(edits), tree.n_tokens, tree.n_chars, zlib.crc32(edited), tree.encoded_chars))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["edits"].alias("edits"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, edited_tokens long, edited_chars long, edited_crc32 long, encoded_chars long")


def production_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with four edits each: a deletion, an insertion, a replacement and an addition at the end, at places that follow from the doc_id."""
    n = F.char_length(F.coalesce(docs["text"], F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), docs["doc_id"]), n + 1).cast("int")
    edit = lambda at, deleted, inserted: F.struct(at.cast("int").alias("at"), F.lit(deleted).cast("int").alias("deleted"), F.lit(inserted).alias("inserted"))
    edits: Sequence = [edit(place(1), 40, ""), edit(place(2), 0, " an added remark"), edit(place(3), 12, "changed"), edit(n + 100, 0, " The end.")]
    return docs.select(docs["doc_id"], docs["text"], F.array(*edits).alias("edits"))


def op4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(production_edits(read(spark, sf_dir, "documents")))
