"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text accepts exactly its substrings. A text is parsed
greedily: each phrase is the longest match that the automaton allows from where the last one ended. The number
of phrases times log2 of the training length, over the text's length, estimates the cross entropy; the
language with the least wins. Texts are normalised alike for training and
prediction: lower case, every run of characters that aren't letters one space. A letter that a language's training text lacks
counts as two phrases, one more than a letter that it has. Any number of letters and languages may occur.

Whole texts are parsed, as one sequence each. For speed a text's blocks of BLOCK characters are parsed side by side, each as if
a phrase began with it; then the phrase that really runs into a block is followed until a phrase begins where one of the block's own
parse does, from where on both are the same. What is still running at the block's end is carried into the next.

Trained on a bounded sample, a parameter: CHARS characters a language, taken from the documents with the smallest
hashes of at most DOCS hash buckets a language. LANGUAGES languages at a time reach the driver and are broadcast, as sparse
automata of under 3 transitions a character (about 1 MB a language); more languages take more passes.

Null texts and texts without a letter are `und` with score 0; so is everything where no row has a label.
Ties go to the language that sorts first; repeated rows get the same answer; null doc_ids are predicted too
(as held out or not by the remainder of an empty key). Other columns are never read by a prediction, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, small_side, stored

CHARS, DOCS, LANGUAGES, BLOCK = 24_000, 64, 64, 512
UNKNOWN, SPACE = 0, 1  # the codes of letters that no training text holds, and of all that isn't a letter
AT_ONCE = 2_000_000  # characters parsed side by side


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def training_texts(docs: DataFrame, chars: int = CHARS, buckets: int = DOCS) -> DataFrame:
    """(lang, doc_id, text): the sample of labelled documents that are not held out, stored."""
    h = F.xxhash64("doc_id")
    own = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and length(text) > 0").filter(remainder() != 2)
    ids = own.groupBy("lang", F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.min_by("doc_id", h).alias("doc_id")).select("lang", "doc_id")
    texts = own.join(small_side(ids, "sample", "lang"), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", F.substring("text", 1, chars).alias("text"))
    return stored(texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "training")


def joined_texts(rows: pd.DataFrame, chars: int = CHARS) -> dict[str, str]:
    """language -> up to `chars` characters, short documents whole and an equal share of the others."""
    out: dict[str, str] = {}
    for lang, own in rows.sort_values(["lang", "doc_id"]).groupby("lang"):
        share = max(1, chars // len(own))
        short = [t for t in own["text"] if len(t) <= share]
        share = (chars - sum(map(len, short))) // max(1, len(own) - len(short))
        out[lang] = "\n".join(t[: max(share, 1)] for t in own["text"]).lower()
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return move


class Automaton:
    """Transitions in one array: those of state s lie at base[s] + symbol, where owner says s. Rows of all states are laid into each other."""

    def __init__(self, move: list[dict[int, int]], width: int):
        rows = [np.fromiter(sorted(m), np.int64, len(m)) for m in move]
        size = sum(map(len, rows)) + 2 * width + 8
        self.base, free = np.zeros(len(move) + 1, np.int64), np.ones(2 * size + width, bool)
        by_size = sorted((s for s in range(len(rows)) if len(rows[s]) > 1), key=lambda s: (-len(rows[s]), s))
        low = 0
        for s in by_size:
            own, at = rows[s], low
            while True:
                while at + 512 + width > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                begin = at + np.flatnonzero(free[at : at + 512])
                begin = begin[begin >= own[0]] - own[0]
                fits = free[begin[:, None] + own].all(1) if len(begin) else begin
                if fits.any():
                    self.base[s] = begin[int(np.argmax(fits))]
                    free[self.base[s] + own] = False
                    break
                at += 512
            while low + 512 < len(free) and not free[low : low + 512].any():
                low += 512
        single = np.array([s for s in range(len(rows)) if len(rows[s]) == 1], np.int64)
        symbol = np.array([rows[s][0] for s in single], np.int64)
        room = width + np.flatnonzero(free[width:])[: len(single)]  # beyond width, so that no base is negative
        if len(room) < len(single):
            room = np.concatenate([room, len(free) + np.arange(len(single) - len(room))])
        self.base[single] = room - symbol
        cells = max(int(self.base.max()) + width + 1, int(room.max(initial=0)) + 1)
        self.owner, self.to = np.full(cells, -1, np.int32), np.zeros(cells, np.int32)
        for s, m in enumerate(move):
            at = self.base[s] + rows[s]
            self.owner[at], self.to[at] = s, [m[c] for c in rows[s].tolist()]
        self.base = self.base.astype(np.int32)
        self.outside = len(move)  # a state without moves: where a text begins, and after a symbol that no phrase holds
        self.begin = np.full(width, self.outside, np.int32)
        self.begin[list(move[0])] = list(move[0].values())

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins)."""
        at = self.base[state] + symbols
        begins = self.owner[at] != state
        return np.where(begins, self.begin[symbols], self.to[at]), begins

    def phrases(self, blocks: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Phrases that begin in each column of blocks (BLOCK x n symbols); a column that goes on continues the text of the one before."""
        rows, n = blocks.shape
        begins, state = np.empty(blocks.shape, bool), np.full(n, self.outside, np.int32)
        for r in range(rows):
            state, begins[r] = self.step(state, blocks[r])
        own, own_exit = begins.sum(0), state
        count, exits, todo = own.copy(), own_exit.copy(), np.flatnonzero(goes_on)
        while len(todo):
            active, state, place = todo, exits[todo - 1], np.arange(len(todo))
            after = own_exit[todo]  # of the blocks in which the two parses meet
            real, passed = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)  # phrases of the text's and of the block's own parse so far
            for r in range(rows):
                state, broken = self.step(state, blocks[r, active])
                theirs = begins[r, active]
                met = broken & theirs
                if met.any():
                    count[active[met]] = own[active[met]] - passed[place[met]] + real[place[met]]
                    left = ~met
                    active, state, place, broken, theirs = active[left], state[left], place[left], broken[left], theirs[left]
                    if not len(active):
                        break
                real[place] += broken
                passed[place] += theirs
            count[active] = real[place]
            after[place] = state
            moved = todo[after != exits[todo]] + 1
            exits[todo] = after
            moved = moved[moved < n]
            todo = moved[goes_on[moved]]
        return count


class Parser:
    """The automata of some languages."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        points = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le", "surrogatepass"), np.uint32))
        letters = [p for p in points.tolist() if chr(p).isalpha()]
        self.codes = np.fromiter((not chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)  # SPACE or, for letters, UNKNOWN
        self.codes[letters] = np.arange(2, len(letters) + 2)
        self.symbols, self.automata, self.bits = [], [], []
        for lang in self.langs:
            coded = self.coded(texts[lang])
            held = np.unique(coded)
            symbol = np.zeros(len(letters) + 2, np.int32)  # 0: not in this language's training text
            symbol[held] = np.arange(1, len(held) + 1)
            self.symbols.append(symbol)
            self.automata.append(Automaton(suffix_automaton(symbol[coded].tolist()), len(held) + 1))
            self.bits.append(float(np.log2(max(2, len(texts[lang])))))

    def coded(self, text: str) -> np.ndarray:
        own = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = own == SPACE
        return own[~(space & np.concatenate([[True], space[:-1]]))] if len(own) else own

    def score(self, texts: list[str]) -> np.ndarray:
        """Cross entropy in bits a character, languages x texts."""
        codes = [self.coded(t.lower()) for t in texts]
        lengths = np.array([len(c) for c in codes])
        n_blocks = np.maximum(1, -(-lengths // BLOCK))
        starts = np.concatenate([[0], np.cumsum(n_blocks)])
        flat = np.full(int(starts[-1]) * BLOCK, UNKNOWN, np.int32)
        for c, s in zip(codes, starts, strict=False):
            flat[s * BLOCK : s * BLOCK + len(c)] = c
        blocks = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        goes_on = np.ones(int(starts[-1]), bool)
        goes_on[starts[:-1]] = False
        out = np.empty((len(self.langs), len(texts)))
        for i, (symbol, automaton) in enumerate(zip(self.symbols, self.automata, strict=True)):
            own = symbol[blocks]
            n = np.add.reduceat(automaton.phrases(own, goes_on) + (own == 0).sum(0), starts[:-1])
            out[i] = (n - 2 * (n_blocks * BLOCK - lengths)) * self.bits[i] / np.maximum(lengths, 1)  # each symbol of the padding counted twice
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:50].isalpha() or any(map(str.isalpha, text)))


def parsed(rows: DataFrame, parser, last: bool) -> DataFrame:
    """rows(doc_id, held_out, text, lang_pred, bits, second) after the languages of one parser; without text after the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = parser.value
        for batch in batches:
            text = batch["text"].tolist()
            lang, best, second = batch["lang_pred"].tolist(), batch["bits"].to_numpy(float, copy=True), batch["second"].to_numpy(float, copy=True)
            todo, held = [], 0
            for i, t in enumerate([*text, None]):
                if has_letter(t):
                    todo.append(i)
                    held += len(t)
                if todo and (held > AT_ONCE or i == len(text)):
                    for name, h in zip(model.langs, model.score([text[j] for j in todo]), strict=True):
                        for j, x in zip(todo, h, strict=True):
                            if x < best[j]:
                                lang[j], best[j], second[j] = name, x, best[j]
                            else:
                                second[j] = min(second[j], x)
                    todo, held = [], 0
            batch = batch.assign(lang_pred=lang, bits=best, second=second)
            yield batch.drop(columns="text") if last else batch

    return mapped(rows, run, f"doc_id long, held_out boolean, {'' if last else 'text string, '}lang_pred string, bits double, second double")


def identify(docs: DataFrame, chars: int = CHARS, buckets: int = DOCS, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the winner's margin over the next, 0 to 1), bits per row."""
    sample = training_texts(docs, chars, buckets)
    names = sorted(r.lang for r in sample.select("lang").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 2).alias("held_out"), "text", F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("bits"), F.lit(float("inf")).alias("second"))
    for at in range(0, len(names), languages):
        own = names[at : at + languages]
        texts = joined_texts(sample.filter(F.col("lang").isin(own)).toPandas(), chars)
        rows = parsed(rows, docs.sparkSession.sparkContext.broadcast(Parser(texts)), at + languages >= len(names))
    found = F.col("bits") < float("inf")
    second = F.when(F.col("second") < float("inf"), F.col("second")).otherwise(F.col("bits"))
    score = F.when(found, 1 - F.col("bits") / F.greatest(second, F.lit(1e-12))).otherwise(0.0)
    return rows.select("doc_id", "held_out", "lang_pred", score.alias("score"), F.when(found, F.col("bits")).alias("bits"))
