"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens that following it settles: when no
child goes on with the next character, the longest piece that starts the unmatched text is popped, and the link leads
to the node that spells what is left. So a word's greedy longest-match count needs one pass over its characters and
never builds a piece. A word is marked by a leading mark (as in the vocabulary, U+2581) and ends at white space.

A character that starts no piece costs `unknown(char)` tokens: the pieces of its UTF-8 bytes where the vocabulary has
byte pieces, else one. Counts of words are kept in a table of bounded size, as most words of a text repeat.

Defined results: null, empty and white-space text has 0 words and 0 tokens; a word of any length is matched whole; equal
texts have equal counts; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import table, utf8

MARK = "▁"
#: The vocabulary file; a path on the driver, which sends the automaton to the tasks.
VOCABULARY = os.environ.get("BINLOOM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
MEMO = 1 << 17


def read_pieces(path: str) -> tuple[list[str], bool]:
    """The pieces of a sentencepiece model (without control and byte pieces), or the lines of a text file; has bytes?"""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        return [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))], any(sp.is_byte(i) for i in ids)
    with open(path, encoding="utf-8") as lines:
        return [x.rstrip("\n") for x in lines if x.rstrip("\n")], False


class LongestMatch:
    """Trie with failure links and popped-token counts over a vocabulary of strings."""

    def __init__(self, pieces: Iterable[str], byte_fallback: bool = False):
        self.byte_fallback = byte_fallback
        self.next: list[dict[str, int]] = [{}]
        self.is_piece, depth_char = [False], [""]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.is_piece.append(False)
                    depth_char.append(c)
                node = child
            if node:
                self.is_piece[node] = True
        n = len(self.next)
        # fail[v]: node left after popping tokens from the string of v; -1 if it has no matching beginning.
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, v in self.next[parent].items():
                queue.append(v)
                if self.is_piece[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def unknown(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1

    def count(self, word: str) -> int:
        """Tokens of greedy longest match over the word."""
        nxt, fail, pops = self.next, self.fail, self.pops
        node, total, i, n = 0, 0, 0, len(word)
        start = 0  # where the unmatched text begins, for the rare case of no piece at all
        while i <= n:
            child = nxt[node].get(word[i]) if i < n else None
            if child is not None:
                node = child
                i += 1
                continue
            if node == 0:
                if i == n:
                    break
                total += self.unknown(word[i])  # no piece starts with this character
                i += 1
                continue
            if fail[node] >= 0:
                total += pops[node]
                node = fail[node]
                continue
            # A beginning of pieces that is none itself and cannot be split: its first characters stand alone.
            start = i - self._depth(node)
            size, popped = self._first(word, start)
            total += popped
            node, i = 0, start + size
        return total

    def _depth(self, node: int) -> int:
        if not hasattr(self, "depths"):
            self.depths = [0] * len(self.next)
            queue = deque([0])
            while queue:
                v = queue.popleft()
                for w in self.next[v].values():
                    self.depths[w] = self.depths[v] + 1
                    queue.append(w)
        return self.depths[node]

    def _first(self, word: str, start: int) -> tuple[int, int]:
        """Length and tokens of the first greedy step at start: the longest piece there, or one unknown character."""
        node, best = 0, 0
        for i in range(start, len(word)):
            node = self.next[node].get(word[i], -1)
            if node < 0:
                break
            if self.is_piece[node]:
                best = i + 1 - start
        return (best, 1) if best else (1, self.unknown(word[start]))


def count_tokens(docs: DataFrame, pieces: Iterable[str] | None = None, byte_fallback: bool = False, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) of every whole text. The vocabulary's size bounds what is broadcast."""
    if pieces is None:
        pieces, byte_fallback = read_pieces(path)
    machine = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces, byte_fallback))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = machine.value.count, {}
        for batch in batches:
            words, tokens, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                parts = text.split()  # ASCII white space of the bytes
                total = 0
                for w in parts:
                    n = memo.get(w)
                    if n is None:
                        n = count(MARK + w.decode("utf-8", "replace"))
                        if len(w) <= 64:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[w] = n
                    total += n
                sizes.append(len(text))
                words.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(x, np.int64)) for x in (sizes, words, tokens))], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(kernel, "doc_id long, n_bytes long, n_words long, n_tokens long")


def op8_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document, with the 32,000-piece vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"))
