"""Abusive, hateful or sexually explicit passages in documents (problem 9).

Compression-distance classification. Two zstandard dictionaries are trained separately, one on ordinary and one on abusive text. A window of
text is scored by the bytes that it takes under the ordinary dictionary beyond those under the abusive one, over the square root
of the former; a document has the score of its largest window, and the threshold is calibrated on held-out labels.

Each dictionary ends with all passages selected for its class, and the abusive one holds the ordinary one before its own training, so that names and
formulas cost as much under either and only what is special to abuse makes a difference.

Nothing of a text is left out. It is cut into passages at sentence ends, lines, comment signs, braces, brackets, dollar signs and commands;
arguments of commands and formulas are passages of their own. Markup inside words is glued first; look-alike characters, spaced-out
and stretched letters are undone. A passage longer than that is scored in sliding windows of ``WORDS`` words. Passages of fewer than ``FEW``
words are also scored joined with their neighbours. A passage of at most ``SHORT`` characters saves less than the bytes in which lengths are
counted, so it is scored by a second pair of dictionaries over text whose every byte is written as four.

Training runs on the driver over a bounded sample of labelled documents: by hash, at most ``LABELLED`` of either label and ``LABELLED_CHARS``
characters in all; when there are more, those kept stand for all of their label in the calibration. Everything else reads all documents, in
one pass without a shuffle. The labels of a document are settled by majority. Which passage of an abusive document is the abusive one is not
labelled: passages that abusive documents repeat and the best scored ones stand for it, over a few rounds, beginning with the seed passages of
:mod:`blockframe.llm.abuse_seeds`.
Labelled documents are in a total order, so a model depends on the rows alone, not on their partitions.

The threshold is the one nearest to ``DEFAULT_THRESHOLD`` among those whose F1 on documents and seeds held out of training is within ``CLOSE``
of the best. Held-out seeds take part with the weight of ``PRIOR`` documents of either kind, so that few labels move the threshold little.

Defined cases: a null, empty or blank text has score 0 and is not abusive; a null source is a source of its own; repeated rows are
scored each; without labels the seeds alone are the model; other columns, whatever their names, are unused.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.abuse_seeds import ABUSIVE, ORDINARY
from blockframe.plans.runtime import durable

#: Documents of either label, and characters in all, that are trained on.
LABELLED, LABELLED_CHARS = 2000, 20_000_000
WORDS, STRIDE = 10, 3
#: Characters per window where a script has no spaces.
SIGNS = 16
#: Words below which a passage is also joined with its neighbours; characters of a short passage.
FEW, SHORT = 4, 24
#: Size of a trained dictionary; the segments that training picks from.
TRAINED_BYTES, SEGMENT, STEP = 128_000, 64, 8
#: Level of the coder. It parses optimally: below, many like passages in a dictionary hide the better match in the rest.
LEVEL = 15
#: Characters of a match from which on the coder takes it as it is, without weighing others against it.
ENOUGH = 24
#: Bytes of difference: of an ordinary passage that may be confused, of the chosen passage of a labelled document.
CONFUSED, CLEAR = 2, 5
#: Words from which on a passage of an abusive document is chosen at CONFUSED, if none of its runs of words is ordinary.
UNUSUAL = 6
#: Bytes that every coded passage takes, that a short one takes at least, and that it counts as beyond these at least.
FRAME, SHORT_FRAME, SHORT_LEAST = 5, 10, 12
ROUNDS, FOLDS, PRIOR = 3, 3, 10.0
#: Words and characters of a run that labels are counted for; how many times more often an abusive run stands in abusive documents.
GRAM, SIGN_GRAM, AGAINST = 3, 6, 30.0
#: Documents labelled abusive, and runs in each of these, from which on a passage is chosen by the labels alone.
REPEATED, RUNS = 3, 4
CLOSE = 0.01
DEFAULT_THRESHOLD = 1.5
GRID = [x / 20 for x in range(18, 81)]
CACHE = 400_000
#: Characters of documents that are scored together.
TOGETHER = 4_000_000

_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­‪-‮]+")
_GLUE = re.compile(
    r"\\-|\\/|\{\}|\\(?:textbf|emph|textit|textsc|texttt|textrm|textsf|underline|uline|text|mbox)\{([^{}]{0,400})\}|\\(?:bf|it|em|sc|tt|small|large)\b ?"
)
#: What stands beside the sentence: arguments of references and settings, optional arguments, formulas. Each part of this pattern and the
#: next begins with its character, which is several times faster to search for.
_SIDE = re.compile(
    r"\\(?:(?:[a-z]*cite[a-z]*|[a-z]*ref|label|bibitem|begin|end|usepackage|documentclass|input|include[a-z]*|bibliography[a-z]*|pagestyle)\*?"
    r"(?:\[[^\]\n]*\])*\{[^}\n]*\}|[a-z]+\*?\[[^\]\n]*\])|\$(?:(?<![a-z]\$)[^$\n]{0,300}\$|[^$\n]{0,300}\$(?![a-z]))"
)
_BREAK = re.compile(r"[.!?;:。！？；{}%|>&\r\\](?:(?<=[。！？；{}%|>&\r])|(?<=[.!?;:])(?=[\s\"'})\]]|$)|(?<=\\)[a-z]+\*?)")
_SWAP = re.compile(r"[@013$547!*|]+(?=[^\W\d_])")
_SPACED, _SPACED_ASCII = re.compile(r"(?<![^\W\d_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W\d_])"), re.compile(r"(?<![a-z])[a-z](?: [a-z]){3,}(?![a-z])")
_SPACES, _RUN = re.compile(r"[^\S\n]+"), re.compile(r"([^\W\d_])\1+")
#: Bytes of ASCII text: letters and line ends as they are, anything else a space.
_TABLE = np.array([i if chr(i).isalpha() or i == 10 else 32 for i in range(128)], np.uint8)
#: Characters that stand for letters.
_LOOK = str.maketrans({"@": "a", "0": "o", "1": "i", "3": "e", "$": "s", "5": "s", "4": "a", "7": "t", "!": "i", "|": "l", "*": None})
_CYRILLIC = str.maketrans("аеорсухікмтнв", "aeopcyxikmthb")
_PLAIN = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalpha() and chr(i) != "\n"})
_LATIN = re.compile(r"[a-z]")
_CYRILLIC_LETTER = re.compile(r"[а-я]")


def raw_passages(text: str) -> tuple[list[str], list[str]]:
    """Passages of a text in lower case, markup that breaks words glued: those of its sentences, and those beside them."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    glued = "\\" in text or "{}" in text
    while glued:  # innermost first
        text, glued = _GLUE.subn(r"\1", text)
    side: list[str] = []

    def aside(m: re.Match) -> str:
        side.append(m[0].strip("$"))
        return " "

    text = _SIDE.sub(aside, text)
    return _BREAK.sub("\n", text).split("\n"), _BREAK.sub("\n", "\n".join(side)).split("\n")


def deepen(raws: list[str]) -> list[str]:
    """Passages as plain words: look-alike characters read as letters, spaced-out words joined, repeated letters once."""
    text = "\n".join(raw if raw.isascii() else _unmixed(raw.replace("\n", " ")) for raw in raws)
    text = _SWAP.sub(_swap, text)
    if text.isascii():
        plain, joined_up = _SPACED_ASCII.subn(_together, _plain_ascii(text))
        if joined_up:
            plain = _plain_ascii(plain)
    else:
        plain = _RUN.sub(r"\1", _SPACED.sub(_together, _SPACES.sub(" ", text.translate(_PLAIN))))
    return [line.strip() for line in plain.split("\n")]


def _plain_ascii(text: str) -> str:
    """Letters and single spaces of an ASCII text, repeated letters once; lines stay."""
    a = _TABLE[np.frombuffer(text.encode(), np.uint8)]
    kept = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=kept[1:])
    kept |= a == 10
    return a[kept].tobytes().decode()


def _unmixed(raw: str) -> str:
    """Cyrillic letters in Latin words as the Latin ones that they look like."""
    if _LATIN.search(raw) and _CYRILLIC_LETTER.search(raw):
        return " ".join(w.translate(_CYRILLIC) if _LATIN.search(w) else w for w in raw.split(" "))
    return raw


def _together(m: re.Match) -> str:
    return m[0].replace(" ", "")


def _swap(m: re.Match) -> str:
    before = m.string[m.start() - 1] if m.start() else " "
    return m[0].translate(_LOOK) if before.isalpha() or before in " \n\"'(" else m[0]


class Passages:
    """Deep passages of texts; results of raw passages met before are kept, ``CACHE`` at most."""

    def __init__(self):
        self.seen: dict[str, str] = {}

    def __call__(self, text: str | None) -> list[str]:
        """The passages, each once: of the sentences, short ones also joined, and those beside the sentences."""
        if not text:
            return []
        main, side = raw_passages(text)
        seen = self.seen
        new = set(main).union(side).difference(seen)
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = set(main).union(side)
        plain = [raw for raw in new if raw.isascii()]
        for raws in (plain, list(new.difference(plain))):
            if raws:
                seen.update(zip(raws, deepen(raws), strict=True))
        main, side = ([d for raw in part if (d := seen[raw])] for part in (main, side))
        return list(dict.fromkeys([*main, *joined(main), *side]))


def joined(passages: list[str]) -> list[str]:
    """Each run of passages of fewer than ``FEW`` words that follow one another, as one passage."""
    out, run = [], []
    for p in [*passages, None]:
        if p is not None and p.count(" ") < FEW - 1:
            run.append(p)
            continue
        if len(run) > 1:
            out.append(" ".join(run))
        run = []
    return out


def sliding(passage: str) -> list[str]:
    """The passage, or its windows if it is longer than one."""
    words = passage.split(" ")
    if len(words) > WORDS + STRIDE:
        starts = [*range(0, len(words) - WORDS, STRIDE), len(words) - WORDS]
        return [" ".join(words[i : i + WORDS]) for i in starts]
    if not passage.isascii() and len(passage) > SIGNS * 1.5 and len(passage) > 12 * len(words):
        starts = [*range(0, len(passage) - SIGNS, SIGNS // 3), len(passage) - SIGNS]
        return [passage[i : i + SIGNS] for i in starts]
    return [passage]


#: Bytes that stand for one of a short passage.
STRETCH = 4
#: The bytes that follow a byte of a short passage.
_NEXT = [bytes((i * (2 * k + 5) + 101 * k) % 256 for i in range(256)) for k in range(1, STRETCH)]


def plain_bytes(passage: str) -> bytes:
    return passage.encode("utf-8", "replace")


def stretched(passage: str) -> bytes:
    """``STRETCH`` bytes for each byte, so that a match of few characters saves several."""
    b = passage.encode("utf-8", "replace")
    out = bytearray(STRETCH * len(b))
    out[::STRETCH] = b
    for k, table in enumerate(_NEXT, 1):
        out[k::STRETCH] = b.translate(table)
    return bytes(out)


def _trained(samples: Iterable[bytes], unit: int = 1) -> bytes:
    """A dictionary trained on samples; these go in hash order, since training picks from runs of neighbours."""
    ordered = sorted(samples, key=lambda p: (zlib.crc32(p), p))
    return zstandard.train_dictionary(TRAINED_BYTES, ordered, k=SEGMENT * unit, d=STEP).as_bytes()


def _pair(good: list[bytes], ordinary: list[bytes], bad: list[bytes], unit: int = 1, background: bytes | None = None) -> tuple[bytes, bytes]:
    """The ordinary and the abusive dictionary: the one trained on ``ordinary`` (or given), then for abuse the one trained on ``bad``, then the
    selected passages, first ones nearest. The shorter is filled up behind the ordinary one, so that this is as far from the text in both.
    """
    gap = b"\n" * unit
    background = background or _trained(ordinary, unit)
    ends = gap + gap.join(reversed(good)), gap + _trained(bad, unit) + gap + gap.join(reversed(bad))
    most = max(map(len, ends))
    return tuple(background + b"\n" * (most - len(e)) + e for e in ends)


class Coder:
    """Compressed length of passages under one dictionary."""

    def __init__(self, dictionary: bytes, unit: int = 1):
        d = zstandard.ZstdCompressionDict(dictionary)
        #: The search of small dictionaries, with tables that hold all of this one.
        log = max(17, len(dictionary).bit_length())
        tables = {"window_log": log, "hash_log": log, "chain_log": log + 1, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
        p = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=64_000, target_length=ENOUGH * unit, write_content_size=0, write_checksum=0, write_dict_id=0, **tables
        )
        d.precompute_compress(compression_params=p)
        self.compress = zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress

    def __call__(self, passage: bytes) -> int:
        return len(self.compress(passage))

    def lengths(self, passages: list[bytes]) -> list[int]:
        """Those of many passages; sorted ones take less time, since they look at the same places of the dictionary."""
        return [*map(len, map(self.compress, passages))]


@dataclass
class Model:
    """Dictionaries (ordinary, abusive) of passages and of short ones, and a threshold."""

    long: tuple[bytes, bytes]
    short: tuple[bytes, bytes]
    threshold: float = DEFAULT_THRESHOLD

    def open(self) -> Model:
        self.passages, self.seen, self.windows = Passages(), {}, {}
        self.plain, self.bad = map(Coder, self.long)
        self.short_plain, self.short_bad = (Coder(d, STRETCH) for d in self.short)
        return self

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("long", "short", "threshold")}

    def learn(self, passages: Iterable[str]) -> None:
        """Keep for each passage the largest score of its windows, and that window; at equal scores the shorter one."""
        seen, held, given = self.seen, self.windows, set(passages)
        new = given.difference(seen)
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = given
        if len(held) > CACHE:
            held.clear()
        short = sorted(p for p in new if len(p) <= SHORT)
        coded = [*map(stretched, short)]
        for p, n, b in zip(short, self.short_plain.lengths(coded), self.short_bad.lengths(coded), strict=True):
            seen[p] = (n - b) / max(SHORT_LEAST, n - SHORT_FRAME) ** 0.5, p
        cut = {p: sliding(p) for p in new if len(p) > SHORT}
        fresh = sorted({w for windows in cut.values() for w in windows}.difference(held))
        coded = [*map(plain_bytes, fresh)]
        lengths = zip(fresh, self.plain.lengths(coded), self.bad.lengths(coded), strict=True)
        score = {w: (n - b) / max(1, n - FRAME) ** 0.5 for w, n, b in lengths}
        for p, windows in cut.items():
            if len(windows) > 1:
                for w in windows:
                    if w in score:
                        held[w] = score[w]
                w = min(windows, key=lambda w: (-held[w], len(w)))
                seen[p] = held[w], w
            else:
                (w,) = windows
                seen[p] = score[w] if w in score else held[w], w

    def document(self, text: str | None) -> tuple[float, str]:
        """Score of a text and the window that has it."""
        return self.of([self.passages(text)])[0]

    def documents(self, texts: Iterable[str | None]) -> Iterator[tuple[float, str]]:
        """Scores of texts, taken together up to ``TOGETHER`` characters."""
        some, n = [], 0
        for text in texts:
            some.append(self.passages(text))
            n += len(text or "")
            if n >= TOGETHER:
                yield from self.of(some)
                some, n = [], 0
        yield from self.of(some)

    def of(self, documents: list[list[str]]) -> list[tuple[float, str]]:
        self.learn(p for d in documents for p in d)
        return [max([(0.0, ""), *(self.seen[p] for p in d)], key=itemgetter(0)) for d in documents]


def shingles(passage: str) -> list[str]:
    """Runs of ``GRAM`` words, or of ``SIGN_GRAM`` characters in a script without spaces."""
    words = passage.split(" ")
    if len(passage) > 2 * SIGN_GRAM * len(words) and not passage.isascii():
        return [passage[i : i + SIGN_GRAM] for i in range(max(1, len(passage) - SIGN_GRAM + 1))]
    return [" ".join(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))]


def _gram_counts(documents: list[list[str]]) -> Counter:
    """Number of documents that hold each run of words."""
    return Counter(g for d in documents for g in {g for w in d for g in shingles(w)})


class Evidence:
    """What the labels say about runs of words, by the share of documents of either label that hold them.

    Shares, since labels favour abusive documents: of a heading that abuse and jokes alike stand under, more than half of the labelled
    documents may be abusive, and few of all documents.
    """

    def __init__(self, positive: list[list[str]], negative: list[list[str]]):
        self.positive, self.negative = _gram_counts(positive), _gram_counts(negative)
        self.ratio = AGAINST * len(positive) / max(1, len(negative))

    def abusive(self, gram: str) -> bool:
        """Whether a run is so much commoner in abusive documents, with some allowance for errors in few labels."""
        n, against = self.positive[gram], self.negative[gram]
        return n >= 2 and n >= self.ratio * (against - 0.5 * against**0.5)

    def ordinary(self, gram: str) -> bool:
        return not self.abusive(gram) and self.negative[gram] >= 1

    def disputed(self, passage: str) -> bool:
        """Whether a passage of a document labelled ordinary is known from abusive ones: the label is taken as an error."""
        return any(map(self.abusive, shingles(passage)))

    def repeated(self, passage: str) -> bool:
        """Whether the labels alone tell that a passage is abusive: several of its runs stand in several abusive documents."""
        return sum(self.positive[g] >= REPEATED and self.abusive(g) for g in shingles(passage)) >= RUNS

    def trimmed(self, passage: str) -> str:
        """The longest part of a passage outside its ordinary runs of words, empty if it is short."""
        grams = shingles(passage)
        if not any(map(self.ordinary, grams)):
            return passage
        unit = 1 if " " not in passage else 0
        parts = list(passage) if unit else passage.split(" ")
        width = SIGN_GRAM if unit else GRAM
        covered = [False] * len(parts)
        for i, g in enumerate(grams):
            if self.ordinary(g):
                covered[i : i + width] = [True] * len(covered[i : i + width])
        runs, begin = [], 0
        for i in range(len(parts) + 1):
            if i == len(parts) or covered[i]:
                runs.append((i - begin, begin))
                begin = i + 1
        n, begin = max(runs, key=lambda r: (r[0], -r[1]))
        return ("" if unit else " ").join(parts[begin : begin + n]) if n >= (SIGN_GRAM if unit else 3) else ""


def _fit(positive: list[list[str]], negative: list[list[str]], seeds: list[str], plain: list[str]) -> Model:
    """Dictionaries from the passages of labelled documents and the seeds."""
    in_negative = Counter(w for d in negative for w in d)
    evidence = Evidence(positive, negative)
    #: Passages known from abusive documents stay out of the ordinary text, or they would cancel out.
    undisputed = {w: not evidence.disputed(w) for w in in_negative}
    ordinary = [plain_bytes(w) for d in [plain, *negative] for w in d if undisputed.get(w, True)]
    background = _trained(ordinary)
    length = Coder(background)
    #: Windows, since these are scored; those short under the ordinary dictionary leave no room for a difference.
    windows = sorted({x for w, good in undisputed.items() if good and len(w) > SHORT for x in sliding(w)})
    known = zip(windows, length.lengths([*map(plain_bytes, windows)]), strict=True)
    room = [(x, plain_bytes(x), n) for x, n in known if n > FRAME + CLEAR]
    own = [sorted({t for w in d if w not in in_negative and (t := evidence.trimmed(w))}) for d in positive]
    parts = {w: sliding(w) for d in own for w in d if len(w) > SHORT}
    scored = sorted({x for xs in parts.values() for x in xs})
    short = [stretched(w) for d in [plain, *negative] for w in d if len(w) <= SHORT and undisputed.get(w, True)] + [stretched(w) for w in plain]
    sure = list(dict.fromkeys(w for d in own for w in d if evidence.repeated(w)))
    bad = list(dict.fromkeys(seeds + sure))
    for _ in range(ROUNDS):
        coded = [plain_bytes(w) for w in bad]
        long = _pair([plain_bytes(w) for w in plain], ordinary, coded, background=background)
        abusive = Coder(long[1])
        confused = [x for (x, _, n), b in zip(room, abusive.lengths([p for _, p, _ in room]), strict=True) if n - b >= CONFUSED]
        long = _pair([plain_bytes(w) for w in plain + confused], ordinary, coded, background=background)
        usual, abusive = map(Coder, long)
        coded = [*map(plain_bytes, scored)]
        saved = {x: n - b for x, n, b in zip(scored, usual.lengths(coded), abusive.lengths(coded), strict=True)}
        chosen = []
        for w, xs in parts.items():
            best = max(map(saved.__getitem__, xs))
            if best >= CLEAR or (best >= CONFUSED and len(w.split(" ")) >= UNUSUAL):
                chosen.append(w)
        bad = list(dict.fromkeys(seeds + sure + chosen))
    #: Names in the passages chosen would make other names look abusive: only runs that mark abuse go to the short ones.
    known_bad = dict.fromkeys(g for w in bad for g in shingles(w) if evidence.abusive(g))
    coded = [stretched(w) for w in dict.fromkeys([*seeds, *known_bad, *(w for w in sure if len(w) <= SHORT)])]
    background, few = _trained(short, STRETCH), [stretched(w) for w in plain]
    usual, abusive = Coder(background, STRETCH), Coder(_pair(few, short, coded, STRETCH, background)[1], STRETCH)
    confused = [w for w in dict.fromkeys(short) if usual(w) - abusive(w) >= CONFUSED]
    return Model(long, _pair(few + confused, short, coded, STRETCH, background))


def _seeds() -> tuple[list[str], list[str]]:
    return deepen([x.lower() for x in ABUSIVE]), deepen([x.lower() for x in ORDINARY])


def train(rows: list[tuple[str | None, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from (text, label), with a threshold calibrated on rows and seeds held out; ``weights`` of label 0 and 1."""
    cut = Passages()
    return _train([(cut(text), label) for text, label in rows], weights)


def _train(rows: list[tuple[list[str], int]], weights: tuple[float, float]) -> Model:
    seeds, plain = _seeds()
    model = _fit([d for d, y in rows if y], [d for d, y in rows if not y], seeds, plain)
    scores: list[tuple[float, int, float]] = []
    order = sorted(range(len(rows)), key=lambda i: -rows[i][1])  # both labels spread over the folds
    for fold in range(FOLDS):
        held = order[fold::FOLDS]
        out = set(held)
        kept = [rows[i] for i in order if i not in out]
        kept_seeds, kept_plain = ([w for k, w in enumerate(ws) if k % FOLDS != fold] for ws in (seeds, plain))
        m = _fit([d for d, y in kept if y], [d for d, y in kept if not y], kept_seeds, kept_plain).open()
        found = m.of([rows[i][0] for i in held])
        scores += [(s, rows[i][1], weights[rows[i][1]]) for i, (s, _) in zip(held, found, strict=True)]
        scores += [(s, y, PRIOR / len(ws)) for y, ws in ((1, seeds), (0, plain)) for s, _ in m.of([[w] for w in ws[fold::FOLDS]])]
    everything = sum(w for _, y, w in scores if y)

    def f1(threshold: float) -> float:
        found = [(y, w) for s, y, w in scores if s >= threshold]
        return 2 * sum(w for y, w in found if y) / (everything + sum(w for _, w in found))

    value = {t: f1(t) for t in GRID}
    top = max(value.values())
    model.threshold = min((t for t in GRID if value[t] >= top - CLOSE), key=lambda t: abs(t - DEFAULT_THRESHOLD))
    return model


def settled(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the majority of a document's labels; a tie counts as not abusive."""
    votes = labels.filter("doc_id IS NOT NULL AND abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("v"))
    return votes.select("doc_id", (F.col("v") > 0.5).cast("int").alias("label"))


def fit(df: DataFrame, labels: DataFrame, labelled: int = LABELLED, characters: int = LABELLED_CHARS, seed: int = 42) -> Model:
    """Train on a bounded sample of the labelled documents (doc_id, text)."""
    texts = df.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    votes = settled(labels)
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    total = {r["label"]: r["count"] for r in votes.groupBy("label").count().collect()}
    chosen = votes.filter("label = 1").orderBy(*order).limit(labelled).unionByName(votes.filter("label = 0").orderBy(*order).limit(labelled))
    known = durable(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"))  # at most 2 * labelled rows
    sizes = sorted(known.select(order[0].alias("h"), "doc_id", F.length("text").alias("n")).collect())
    ends = np.cumsum([r["n"] for r in sizes])
    last = sizes[min(len(sizes) - 1, int(np.searchsorted(ends, characters)))] if sizes else (0, 0)
    within = (order[0] < last[0]) | ((order[0] == last[0]) & (F.col("doc_id") <= last[1]))
    rows = [(r["text"], r["label"]) for r in sorted(known.filter(within).select(order[0], "doc_id", "text", "label").collect())]
    kept = Counter(y for _, y in rows)
    return train(rows, tuple(total.get(y, 0) / max(1, kept[y]) for y in (0, 1)))


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_column, *keep, score DOUBLE, abusive BOOLEAN, evidence): every document scored, in one pass without a shuffle."""
    columns = [id_column, *keep]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value if hasattr(shared.value, "seen") else shared.value.open()
        for batch in batches:
            gc.disable()  # what is kept holds no cycles, and there is much of it to walk through
            try:
                found = [*m.documents(v.as_py() for v in batch.column(len(columns)))]
            finally:
                gc.enable()
            scores = [s for s, _ in found]
            out = [pa.array(scores, pa.float64()), pa.array([s >= m.threshold for s in scores], pa.bool_()), pa.array([w for _, w in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *out], [*columns, "score", "abusive", "evidence"])

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, score double, abusive boolean, evidence string")


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, abusive, rate): the share of abusive documents of every source, null included."""
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("abusive").cast("bigint")).alias("abusive"),
        F.avg(F.col("abusive").cast("double")).alias("rate"),
    )
