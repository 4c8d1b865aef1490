"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The text is marked (a mark before it and for each space) and cut where no piece can reach across: before a run of
marks and around line feeds. The distinct cut words of a batch are sorted, which is the depth-first order of their
trie, and walked with one stack of forward scores: a word keeps the scores of the prefix it shares with the
word before and computes only what differs. Characters without a piece become byte pieces.

The best segmentation is the likeliest: scores are log probabilities. A file of merges has ranks instead; they get the
probabilities of Zipf's and Mandelbrot's law, proportional to 1 / (rank + SHIFT).

Ties between segmentations go to the longer last piece. Known words are kept up to a bound; memory is that
of one batch, whose longest text is held whole. Null and empty texts have no pieces; repeated rows encode alike; other columns are kept by
encoded(), and where they have the names of its own, underscores are added to these. No rows give no rows.
The model file is read on the driver; its pieces (tens of thousands) are broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, mapped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KNOWN = 100_000  # words kept between batches
CHUNK = 500_000  # characters encoded at once
UNKNOWN = 10.0  # an unknown character scores this much below the worst piece
SHIFT = 2.7


def log_probabilities(scores: list[float]) -> list[float]:
    """The scores of a file, or those that its ranks (0, -1, -2, ...) stand for."""
    if any(s != int(s) or s > 0 for s in scores):
        return scores
    total = sum(1 / (SHIFT - s) for s in scores)
    return [-math.log((SHIFT - s) * total) for s in scores]


class Pieces:
    """The vocabulary: a trie of reversed pieces for the search, the bytes of each id for decoding."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.back: dict = {}
        self.worst = 0.0
        pieces: list[str] = []
        at: list[int] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                pieces.append(piece)
                at.append(i)
        for piece, i, score in zip(pieces, at, log_probabilities([model.get_score(i) for i in at]), strict=True):
            self.add(piece, i, score)
        self.unknown = self.worst - UNKNOWN
        cuts = "" if any("\n" in p for p in pieces) else "\n"
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a mark inside: words can't be cut at marks")
        self.cut = re.compile(f"{MARK}+[^{MARK}{cuts}]*|[^{MARK}{cuts}]+" + (f"|{cuts}" if cuts else ""))

    def add(self, piece: str, i: int, score: float) -> None:
        node = self.back
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = (score, i)
        self.worst = min(self.worst, score)

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as int32 bytes), for words in sorted order."""
        best, via, before = [0.0], [(0, 0)], ""  # forward scores and (start, id; -1: byte pieces) at each place
        back, unknown = self.back, self.unknown
        for word in words:
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], via[shared + 1 :]
            for end in range(shared, len(word)):
                top, come, node, start = None, None, back, end
                while start >= 0:
                    node = node.get(word[start])
                    if node is None:
                        break
                    own = node.get("")
                    if own is not None:
                        score = best[start] + own[0]
                        if top is None or score >= top:
                            top, come = score, (start, own[1])
                    start -= 1
                if word[end] not in back or "" not in back[word[end]]:  # no piece of one character
                    score = best[end] + unknown
                    if top is None or score > top:
                        top, come = score, (end, -1)
                best.append(top)
                via.append(come)
            ids, at = [], len(word)
            while at:
                start, i = via[at]
                if i >= 0:
                    ids.append(i)
                else:
                    ids.extend(self.byte_id[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
                at = start
            before = word
            yield word, np.array(ids[::-1], np.int32).tobytes()

    def decode(self, ids) -> str:
        """The text of ids: the first mark's space goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[data[:1] == b" " :].decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; keeps the words it knows."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """int32 ids of each text, in order."""
        chunk, held = [], 0
        for i, t in enumerate(texts):
            chunk.append(self.pieces.words(t or ""))
            held += len(t or "")
            if held >= CHUNK or i == len(texts) - 1:
                new = set().union(*chunk).difference(self.known)
                if len(self.known) + len(new) > KNOWN:
                    self.known.clear()
                    new = set().union(*chunk)
                self.known.update(self.pieces.encode_sorted(sorted(new)))
                for words in chunk:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
                chunk, held = [], 0


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs without text but with input_ids array<int> and n_tokens long."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    kept = [f for f in docs.schema if f.name != "text"]
    columns = [f.name for f in kept]
    own = free_names(columns, "input_ids", "n_tokens")
    schema = T.StructType([*kept, T.StructField(own[0], T.ArrayType(T.IntegerType())), T.StructField(own[1], T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(pieces.value)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                ids = list(encoder.encode(part["text"].tolist()))
                yield part[columns].assign(**{own[0]: ids, own[1]: [len(x) for x in ids]})

    return mapped(docs, run, schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows(input_ids, ...) with text string in place of input_ids."""
    pieces = rows.sparkSession.sparkContext.broadcast(Pieces(model))
    kept = [f for f in rows.schema if f.name not in ("text", "input_ids")]
    columns = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[columns].assign(text=[None if x is None else pieces.value.decode(x.tolist()) for x in batch["input_ids"]])

    return mapped(rows.drop("text"), run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32 (of the int32 ids), exact (decoding gives the text, marks as spaces)."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces.value
        encoder = Encoder(model)
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for doc_id, t, ids in zip(batch["doc_id"], texts, encoder.encode(texts), strict=True):
                back = model.decode(ids.tolist()) if len(ids) else ""
                out.append((doc_id, len(t or ""), len(ids), zlib.crc32(ids.tobytes()), back == (t or "").replace(MARK, " ")))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "n_tokens", "ids_crc32", "exact"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, exact boolean")
