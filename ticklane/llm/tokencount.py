"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building pieces.

A vocabulary has pieces that begin a word and pieces that continue one; each kind is a trie.  An empty piece among those that
begin words is the bare mark of a word's begin: a token of its own where no longer piece begins the word.  Every node has a failure link
(where matching goes on when the next letter has no edge) and the number of pieces that are settled on the way there, both
precomputed, so a word is counted in time linear in its length however long its pieces are.

Defined cases: a null or empty text has no words and no tokens; a word that the pieces cannot spell is one unknown token;
words are ASCII-white-space separated; there is no limit on a word's length; repeated rows are counted like any; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticklane.llm.shared import map_batches

_MANY = 1 << 21  # over every code point
#: Distinct words whose counts a task remembers.
REMEMBERED = 200_000


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin words and pieces that continue them, of a sentencepiece model or a word-piece vocabulary text."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return [p[1:] for p in plain if p[0] == "▁"], [p for p in plain if "▁" not in p]
    with open(path, encoding="utf-8") as lines:
        plain = [x.rstrip("\r\n") for x in lines]
    return [p for p in plain if p and not p.startswith("##")], [p[2:] for p in plain if p.startswith("##") and len(p) > 2]


def default_vocabulary() -> str:
    """Path of a public vocabulary; another one is passed as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Automaton:
    """Nodes 0 (a word's begin) and 1 (a word goes on) are the roots; edges are keyed node * 2**21 + letter."""

    def __init__(self, begin: list[str], rest: list[str]):
        edges: dict[int, int] = {}
        final = [False, False]
        parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, begin), (1, rest)):
            for piece in pieces:
                node = root
                for letter in map(ord, piece):
                    key = node * _MANY + letter
                    if key not in edges:
                        edges[key] = len(final)
                        parent.append((node, letter))
                        final.append(False)
                    node = edges[key]
                final[node] = True
        out: list[list[int]] = [[] for _ in final]
        for node in range(2, len(final)):
            out[parent[node][0]].append(node)
        fail, popped = [-1] * len(final), [0] * len(final)
        if final[0]:
            fail[0], popped[0] = 1, 1
        queue = deque([*out[0], *out[1]])
        while queue:  # nearer the root first: a link leads to a node that is done
            node = queue.popleft()
            queue.extend(out[node])
            if final[node]:
                fail[node], popped[node] = 1, 1
                continue
            up, letter = parent[node]
            link, count = fail[up], popped[up]
            while link >= 0 and link * _MANY + letter not in edges:
                count += popped[link]
                link = fail[link]
            if link >= 0:
                fail[node], popped[node] = edges[link * _MANY + letter], count
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: str) -> int:
        """Number of pieces of a word; 0 if the pieces cannot spell it."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for letter in map(ord, word):
            step = edges.get(node * _MANY + letter)
            while step is None:
                link = fail[node]
                if link < 0:
                    return 0
                total += popped[node]
                node = link
                step = edges.get(node * _MANY + letter)
            node = step
        while node != 1:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row of docs (doc_id, text); unknown words count as a token each."""
    pieces = load_pieces(vocabulary or default_vocabulary())
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Automaton(*shared.value).count
        known: dict[bytes, int] = {}
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                for word, times in Counter(words).items():
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = count(word.decode("utf-8", "surrogatepass"))
                    found[i, 1] += times * (n or 1)
                    found[i, 2] += times * (not n)
                found[i, 0] = len(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), counted, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
