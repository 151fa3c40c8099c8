"""Language identification by unigrams marginalised over segmentations.

A word is scored as the sum, over all ways to cut it into pieces of a fixed public
vocabulary, of the product of the pieces' probabilities in a language; the forward
algorithm sums them. The probabilities of each language are learned by expectation
maximisation: the expected number of times a piece is used over all segmentations of the
words of labelled texts. Words are counted in Spark by language, expected uses are summed
in Spark by language and piece, and only the probabilities (pieces times languages) reach
the driver and all tasks.

Words are lower-cased and begin with a mark; a character without a piece is one unknown
piece. A word is summed over whole, however long it is: the forward pass keeps the last
positions that a piece can reach back to, and is scaled anew every few characters, with the
logarithm of the scale aside. Every word of a text counts; the distinct words of a chunk of
texts are scored once.

Languages are learned from about ``max_labelled`` rows, dealt evenly: of a language with fewer
rows than its part all are taken, of others a share chosen by a hash. The shares of all labelled
rows are the prior.

Defined cases: a null text or one without a letter is "und" with score 0; texts or
languages that are null teach nothing; without anything to learn from all is "und"; at
equal scores the first language wins; equal texts get equal languages; an empty table
gives an empty table; other columns, whatever their names, are not read. More than
``MAX_LANGUAGES`` different languages raise ``ValueError``, as the table of probabilities
goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import mixed, powers, spread, word_chunks

UNKNOWN = "und"
#: Languages whose probabilities, 32,000 or so each, a task can hold.
MAX_LANGUAGES = 200
#: Characters between two scalings, and numbers of a batch of words. Probabilities down to 1e-15
#: keep their digits over the longest piece and that many characters.
RESCALE, BATCH = 4, 4_000_000
MARK = "▁"
SMOOTHING = 0.05


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of a sentencepiece model, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [
        p
        for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and p == p.lower()
    ]


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, np.uint32), np.array([len(w) for w in words], np.int64)


class Pieces:
    """Finds the pieces that end at each character of many words."""

    def __init__(self, pieces: list[str]):
        points, lengths = _code_points(pieces)
        self.longest = int(lengths.max()) if len(lengths) else 1
        self.factors = powers(self.longest + 2, np.uint64(0x5851F42D4C957F2D))
        hashes = np.zeros(len(pieces), np.uint64)
        ends = np.cumsum(lengths)
        for k in range(self.longest):
            has = lengths > k
            hashes[has] += (points[ends[has] - 1 - k].astype(np.uint64) + np.uint64(1)) * (
                self.factors[k]
            )
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.ids = np.argsort(mixed(hashes))
        self.sorted = mixed(hashes)[self.ids]
        # most windows hold no piece: their first bits tell
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.sorted >> np.uint64(44)] = True

    def ending(self, words: np.ndarray) -> np.ndarray:
        """Piece ids by end, row and place of the start, for a matrix of characters.

        Start ``s`` has the place ``s % longest``; places without a piece hold ``none``.
        """
        rows, n = words.shape
        out = np.full((n, rows, self.longest), self.none, np.int32)
        points = words.T.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, rows), np.uint64)
        for k in range(min(self.longest, n)):
            h[k:] += points[: n - k] * self.factors[k]
            key = mixed(h[k:])
            end, row = np.nonzero(self.seen[key >> np.uint64(44)])
            key = key[end, row]
            place = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            hit = self.sorted[place] == key if len(self.sorted) else np.zeros(len(key), bool)
            end, row, ids = end[hit] + k, row[hit], self.ids[place[hit]]
            if k == 0:
                out[np.arange(n), :, np.arange(n) % self.longest] = self.unknown
            out[end, row, (end - k) % self.longest] = ids
        return out


def _by_length(
    words: list[str], by_char: int, by_word: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of words, longest first: which they are, their lengths and their characters.

    A batch is as large as so many numbers for each character and each word allow.
    """
    points, lengths = _code_points(words)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        part = order[at : at + max(1, BATCH // (longest * by_char + by_word))]
        # much shorter words go to a batch of their own
        part = part[: max(1, int(np.searchsorted(-lengths[part], -(longest // 2), side="right")))]
        n = lengths[part]
        chars = np.zeros((len(part), longest), np.uint32)
        chars[np.repeat(np.arange(len(part)), n), spread(np.zeros_like(n), n)] = points[spread(first[part], n)]
        yield part, n, chars
        at += len(part)


def _forward(ids: np.ndarray, table: np.ndarray, lengths: np.ndarray, every: bool):
    """Logarithms of the sums over all segmentations up to each end, or of whole words only.

    ``table`` has a row of zeros at the end; ``lengths`` do not rise.
    """
    n, rows, longest = ids.shape
    langs = table.shape[1]
    ring = np.zeros((rows, longest, langs))
    ring[:, 0] = 1
    scale = np.zeros((rows, langs))
    kept = np.zeros((n + 1, rows, langs)) if every else None
    out = np.zeros((rows, langs))
    for end in range(1, n + 1):
        live = int(np.searchsorted(-lengths, -end, side="right"))  # words of this length at least
        ring, scale = ring[:live], scale[:live]
        now = np.einsum("rkl,rkl->rl", ring, table[ids[end - 1, :live]])
        ring[:, end % longest] = now
        if every:
            kept[end, :live] = np.log(now) + scale
        done = int(np.searchsorted(-lengths, -end, side="left"))
        if done < live:
            out[done:live] = np.log(now[done:]) + scale[done:]
        if end % RESCALE == 0:
            most = ring.max(axis=1)
            ring /= most[:, None]
            scale = scale + np.log(most)
    return out, kept


def log_probabilities(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural logarithm of each word's probability in each language (rows of ``table``)."""
    table = np.concatenate((table, np.zeros((1, table.shape[1]))))
    out = np.zeros((len(words), table.shape[1]))
    for which, lengths, chars in _by_length([MARK + w for w in words], pieces.longest, pieces.longest * table.shape[1]):
        out[which], _ = _forward(pieces.ending(chars), table, lengths, False)
    return out


def expected_uses(
    pieces: Pieces, table: np.ndarray, words: list[str], counts: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece in each language, for words seen ``counts[word, language]`` times."""
    langs = table.shape[1]
    uses = np.zeros_like(table)
    table = np.concatenate((table, np.zeros((1, langs))))
    with np.errstate(divide="ignore"):
        logs = np.log(table)
    longest = pieces.longest
    for which, lengths, chars in _by_length([MARK + w for w in words], longest + langs, 2 * longest * langs):
        ids = pieces.ending(chars)
        total, before = _forward(ids, table, lengths, True)
        n, rows, _ = ids.shape
        ring = np.zeros((rows, longest, langs))
        scale = np.zeros((rows, langs))
        weight = counts[which]
        for end in range(n, 0, -1):
            live = int(np.searchsorted(-lengths, -end, side="right"))
            done = int(np.searchsorted(-lengths, -end, side="left"))
            ring[done:live, end % longest] = 1  # words that end here
            here = ring[:live, end % longest].copy()
            ring[:live, end % longest] = 0
            row, place = np.nonzero(ids[end - 1, :live] != pieces.none)
            piece = ids[end - 1, row, place]
            start = end - 1 - (end - 1 - place) % longest
            step = here[row] * table[piece]
            ring[row, place] += step
            with np.errstate(divide="ignore"):
                log = before[start, row] + logs[piece] + np.log(here[row]) + scale[row] - total[row]
            value = np.exp(log) * weight[row]
            for k in range(langs):
                uses[:, k] += np.bincount(piece, value[:, k], len(uses))
            if end % RESCALE == 0:
                most = ring[:live].max(axis=1)
                ring[:live] /= most[:, None]
                scale[:live] += np.log(most)
    return uses


def _types(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[str], np.ndarray]]:
    """For chunks of lower-cased texts: their range, owners of words, distinct words, which is which."""
    lowered = pc.utf8_lower(texts.fill_null(""))
    for i, j, words in word_chunks(lowered, limit=1 << 20):
        if len(words.starts):
            coded = words.array().dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            yield i, j, words.owners, coded.dictionary.to_pylist(), which
        else:
            yield i, j, np.zeros(0, np.int64), [], np.zeros(0, np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of = langs.indices.to_numpy(zero_copy_only=False)
        for i, _, owners, types, which in _types(batch.column(1)):
            pair, n = np.unique(of[i + owners] * len(types) + which, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(pair // max(len(types), 1))),
                    pa.array(types, pa.string()).take(pa.array(pair % max(len(types), 1))),
                    pa.array(n, pa.int64()),
                ],
                names=["lang", "word", "n"],
            )


class _Expect:
    def __init__(self, pieces: list[str], langs: list[str], held):
        self.pieces, self.langs, self.held = pieces, langs, held

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(self.pieces)
        table = self.held.value
        place = {x: i for i, x in enumerate(self.langs)}
        uses = np.zeros_like(table)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            words = coded.dictionary.to_pylist()
            counts = np.zeros((len(words), len(self.langs)))
            which = [place[x] for x in batch.column(0).to_pylist()]
            np.add.at(
                counts,
                (coded.indices.to_numpy(zero_copy_only=False), which),
                batch.column(2).to_numpy(zero_copy_only=False),
            )
            uses += expected_uses(pieces, table, words, counts)
        piece, lang = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[piece, lang])],
            names=["lang", "piece", "uses"],
        )


def learn(
    labelled: DataFrame, pieces: list[str], langs: list[str], *, rounds: int = 2
) -> np.ndarray:
    """The probability of each piece in each language."""
    kinds = "lang string, word string, n long"
    counted = labelled.select("lang", "text").mapInArrow(_count_words, kinds)
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    table = np.full((len(pieces) + 1, len(langs)), 1 / (len(pieces) + 1))
    # an unknown character is worth less than any piece
    table[-1] /= len(pieces) + 1
    for _ in range(rounds):
        held = labelled.sparkSession.sparkContext.broadcast(table)
        rows = (
            words.mapInArrow(_Expect(pieces, langs, held), "lang int, piece int, uses double")
            .groupBy("lang", "piece")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        uses = np.zeros_like(table)
        uses[rows["piece"], rows["lang"]] = rows["uses"]
        table = (uses + SMOOTHING) / (uses + SMOOTHING).sum(axis=0)
        table[-1] = np.minimum(table[-1], 1e-7)
        held.destroy()
    return table


def parts_of(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many rows to take of each language: as even as the counts allow."""
    out, left = {}, total
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def chosen(known: DataFrame, counts: dict[str, int], total: int) -> DataFrame:
    """About ``total`` rows of ``known(id, text, lang)``, by a hash of id and text."""
    bits = 60
    limits = []
    for lang, n in parts_of(counts, total).items():
        share = (1 << bits) * n // counts[lang]  # all rows of a rare language
        limits += [F.lit(lang), F.lit(share)]
    place = F.xxhash64(F.lit("lang"), "id", "text").bitwiseAND(F.lit((1 << bits) - 1))
    return known.where(place < F.create_map(*limits)[F.col("lang")])


class _Predict:
    def __init__(self, pieces: list[str], langs: list[str], prior: np.ndarray, held):
        self.pieces, self.langs, self.prior, self.held = pieces, langs, prior, held

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(self.pieces)
        for batch in batches:
            texts = batch.column(1)
            score = np.tile(np.log(self.prior), (len(texts), 1))
            for i, _, owners, types, which in _types(texts):
                if len(types):
                    values = log_probabilities(pieces, self.held.value, types)
                    for k in range(len(self.langs)):
                        score[:, k] += np.bincount(
                            i + owners, values[which, k], minlength=len(texts)
                        )
            best = score.argmax(axis=1)
            share = 1 / np.exp(score - score.max(axis=1)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(self.langs, object)[best], pa.string()),
                    pa.array(share),
                    batch.column(2),
                ],
                names=["id", "lang", "score", "extra"],
            )


def predict_language(
    docs: DataFrame,
    labelled: DataFrame,
    vocabulary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_labelled: int = 20_000,
    rounds: int = 2,
) -> DataFrame:
    """``id, lang, score`` of each row of ``docs``, learned from about ``max_labelled`` rows of
    ``labelled``; ``score`` is the posterior probability of the language.
    """
    pieces = vocabulary(vocabulary_path)
    known = labelled.select(
        labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")
    ).where("text is not null and lang is not null")
    seen = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    counts = {r["lang"]: r["n"] for r in seen}
    langs = sorted(counts)
    rows = docs.select(
        docs[id_col].alias("id"),
        docs[text_col].alias("text"),
        F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    if not langs:
        return rows.select("id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    table = learn(chosen(known, counts, max_labelled), pieces, langs, rounds=rounds)
    prior = np.array([counts[x] for x in langs], float)
    prior /= prior.sum()
    held = docs.sparkSession.sparkContext.broadcast(table)
    found = rows.mapInArrow(
        _Predict(pieces, langs, prior, held), f"id {kind}, lang string, score double, extra boolean"
    )
    return found.select(
        "id",
        F.when(F.col("extra"), F.col("lang")).otherwise(UNKNOWN).alias("lang"),
        F.when(F.col("extra"), F.col("score")).otherwise(0.0).alias("score"),
    )
