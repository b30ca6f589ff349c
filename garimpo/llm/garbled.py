"""Garbled text: text whose bytes were decoded in an encoding they were not written in.

Method: characters are mapped back to the bytes of a legacy encoding, an automaton over the structure of UTF-8 finds the
maximal spans of well-formed multibyte sequences, and only those spans are decoded, again and again while that helps. A
span that could also be natural writing (an upper-case accented letter before a closing quote, a box drawing) counts only
if its surroundings or other spans of the same text speak for garbling.

Bytes of one single-byte encoding read in another leave no such structure. For these, words are mapped the same
way between pairs of encodings, and a word counts where the mapped word is far more frequent in the whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.runtime import checkpoint

#: Encodings that UTF-8 bytes may have been read in. The first stands for cp1252 and latin-1 mixed.
READ_AS = ["western", "cp1250", "cp1251", "mac_roman", "cp850", "cp437", "cp1254", "iso8859_15", "iso8859_2", "koi8_r"]
#: Fixed values: (written in, read as) of single-byte encodings.
SINGLE_BYTE = [(w, r) for w in ("cp1252", "mac_roman", "cp850") for r in ("western", "mac_roman", "cp1250", "cp1251", "cp850", "cp437", "koi8_r", "iso8859_2") if (w, r) not in {("cp1252", "western"), ("mac_roman", "mac_roman"), ("cp850", "cp850")}]
#: Characters that a word of the supported languages may hold, as the goal of a repair.
GOAL = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ‘’“”«»—–…¿¡°")
#: Continuation bytes that also end a word naturally, as they look in western text.
CLOSING = frozenset("\xa0»”’‘“„‚…–—›‹«•·­")
#: A repaired word must be found in so many times as many rows, or different texts, as the word itself.
RATIO = 5
#: A repaired word must be found in so many rows, or different texts, at least.
LEAST = 5
_WORD = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_LOST = re.compile("\ufffd+")
_C1 = re.compile("[\x80-\x9f]")
_FLUSH = 200_000
#: Most hashes of repeated texts that are broadcast; beyond it the join shuffles.
SMALL = 200_000


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[str, int]:
    """Characters of the upper half of an encoding to their bytes."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        if encoding == "western":
            out[chr(b)] = b
        try:
            c = bytes([b]).decode("cp1252" if encoding == "western" else encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=None)
def automaton(encoding: str) -> re.Pattern:
    """Finds the maximal runs of well-formed multibyte sequences in text read in ``encoding``."""
    t = byte_table(encoding)

    def of(*spans: tuple[int, int]) -> str:
        return "[" + "".join(re.escape(c) for c, b in t.items() if any(x <= b <= y for x, y in spans)) + "]"

    tail = of((0x80, 0xBF))
    forms = [
        of((0xC2, 0xDF)) + tail,
        of((0xE0, 0xE0)) + of((0xA0, 0xBF)) + tail,
        of((0xE1, 0xEC), (0xEE, 0xEF)) + tail + tail,
        of((0xED, 0xED)) + of((0x80, 0x9F)) + tail,
        of((0xF0, 0xF0)) + of((0x90, 0xBF)) + tail + tail,
        of((0xF1, 0xF3)) + tail * 3,
        of((0xF4, 0xF4)) + of((0x80, 0x8F)) + tail + tail,
    ]
    return re.compile("(?:" + "|".join(f for f in forms if "[]" not in f) + ")+")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    text: str
    strong: bool


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _known(text: str) -> bool:
    return all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in text)


def _strong(text: str, m: re.Match, got: str, encoding: str) -> bool:
    """Whether the span cannot well be natural writing."""
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    raw = m.group()
    letters = [c for c in got if c.isalpha()]
    latin_near = (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())
    lower_near = (before.isascii() and before.islower()) or (after.isascii() and after.islower())
    if encoding in ("cp1251", "koi8_r"):
        if any(x.isalpha() and _script(x) == "CYRILLIC" for x in (before, after) if x):
            return False
    if encoding in ("cp437", "cp850") and any("─" <= x <= "▟" for x in (before, after) if x):
        return False
    if len(got) == 1:
        c = got
        if len(raw) == 2:
            if not ("\xa0" <= c <= "\xff"):
                # one letter of another block: only inside a word
                return c.isalpha() and _script(c) == "LATIN" and lower_near and raw[1] not in "”’»…" and c < "ƀ"
            if encoding == "western":
                if raw[1] == "\xa0":
                    return lower_near or not (before.isalpha() if c == "à" else before.isspace() or before.isalpha() or not before)
                if raw[1] in CLOSING:
                    # a middle dot that stands alone between blanks was no end of a word
                    return lower_near or raw == "Â·" and not before.strip() and not after.strip()
                if before.isascii() and before.isupper() and not lower_near:
                    return raw[1] not in "ªº°®™"
                return True
            return latin_near or "─" <= raw[0] <= "╿" and not "─" <= raw[1] <= "▟"
        if len(raw) == 3:
            if "‐" <= c <= "‧" or "‰" <= c <= "⁞" or c in "€™":
                return True
            if "←" <= c <= "⯿" or "₀" <= c <= "₿":
                return not lower_near or "\x80" <= raw[1] <= "\x9f" or "\x80" <= raw[2] <= "\x9f"
            # letters and closing signs after an accented letter are natural
            return not any(x in CLOSING or x.isalpha() for x in raw[1:])
        return True
    if encoding == "western" or latin_near:
        return True
    scripts = {_script(c) for c in letters}
    return len(got) >= 3 and len(scripts) <= 2 and scripts <= {"CYRILLIC", "GREEK", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "LATIN", "HANGUL"} or not letters and len(got) >= 2 and len(raw) >= 6


def spans(text: str, encoding: str) -> list[Span]:
    """Well-formed spans of ``text`` mapped back to the bytes of ``encoding``, with what they decode to."""
    out = []
    t = byte_table(encoding)
    for m in automaton(encoding).finditer(text):
        got = bytes(t[c] for c in m.group()).decode("utf-8")
        if _known(got):
            out.append(Span(m.start(), m.end(), got, _strong(text, m, got, encoding)))
    return out


def _controls(text: str) -> list[int]:
    """C1 control characters that stand where cp1252 has a letter or a quote, beside a letter."""
    return [i for i, c in enumerate(text) if "\x80" <= c <= "\x9f" and c not in "\x81\x85\x8d\x8f\x90\x9d" and (text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha())]


def _lost(text: str) -> bool:
    """Whether a replacement character stands for a lost one; alone within quotes or brackets it is only mentioned."""
    quotes = {"'": "'", '"': '"', "`": "`", "(": ")", "[": "]", "«": "»", "“": "”", "‘": "’"}
    return any(not (m.start() and quotes.get(text[m.start() - 1]) == text[m.end() : m.end() + 1]) for m in _LOST.finditer(text))


@lru_cache(maxsize=100_000)
def _any_span(run: str) -> bool:
    return any(automaton(e).search(run) for e in READ_AS)


def repair(text: str, rounds: int = 4) -> tuple[bool, str]:
    """Whether ``text`` is garbled by structure, and the text with its garbled spans decoded."""
    found = "\ufffd" in text and _lost(text)
    for _ in range(rounds):
        # a multibyte sequence lies within a run of characters beyond ASCII; most runs of natural text hold none
        if not any(map(_any_span, set(_RUN.findall(text)))):
            break
        best: list[Span] = []
        for e in READ_AS:
            s = spans(text, e)
            if sum(x.strong for x in s) > sum(x.strong for x in best):
                best = s
        if not best:
            break
        found = True
        out, at = [], 0
        for x in best:
            out += [text[at : x.start], x.text]
            at = x.end
        text = "".join([*out, text[at:]])
    if _C1.search(text) and (c1 := _controls(text)):
        found = True
        chars = list(text)
        for i in c1:
            chars[i] = bytes([ord(chars[i])]).decode("cp1252")
        text = "".join(chars)
    return found, text


@lru_cache(maxsize=None)
def _pairs() -> tuple[tuple[str, str, dict[int, str], frozenset[str], frozenset[str]], ...]:
    """(written in, read as, what each misread character was, the misread characters of goal letters, goal letters read right)."""
    out = []
    for w, r in SINGLE_BYTE:
        m, same = {}, set()
        for c, b in byte_table(r).items():
            if c < "\x80" or (r == "western" and "\x80" <= c <= "\x9f"):
                continue
            try:
                was = bytes([b]).decode(w)
            except UnicodeDecodeError:
                continue
            if was != c:
                m[c] = was
            elif c in GOAL:
                same.add(c)
        bad = frozenset(c for c, was in m.items() if was in GOAL)
        out.append((w, r, {ord(c): was for c, was in m.items()}, bad, frozenset(same)))
    return tuple(out)


@lru_cache(maxsize=200_000)
def misreadings(word: str) -> tuple[str, ...]:
    """What ``word`` may have been, if it was misread: every character beyond ASCII must become, or stay, one of the goal, and one change."""
    if not any(c.isascii() for c in word):
        return ()
    odd = {c for c in word if c > "\x7f"}
    out = []
    for _, _, m, bad, same in _pairs():
        if not odd.isdisjoint(bad) and odd <= bad | same:
            out.append(word.translate(m))
    return tuple(dict.fromkeys(out))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: found by structure (kind 0); its words that may be misread (1); per task: rows of each word and different texts of it (2)."""
    words: Counter = Counter()
    texts: Counter = Counter()

    def rows(kind: list, row: pa.Array, a: list, b: list, n: list, m: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), row, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.float64())], ["kind", "chave", "word", "was", "n", "m"])

    empty = None
    for batch in batches:
        empty = batch.column(0).slice(0, 0)
        kind, at, a, b, n = [], [], [], [], []
        for i, (t, copies) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if repair(t)[0]:
                kind.append(0), at.append(i), a.append(None), b.append(None), n.append(1)
            own = {w for w in _WORD.findall(t) if not w.isascii()}
            words.update(own)
            for w in own:
                texts[w] += 1 / copies
                for x in misreadings(w):
                    kind.append(1), at.append(i), a.append(w), b.append(x), n.append(1)
        if kind:
            yield rows(kind, batch.column(0).take(pa.array(at, pa.int64())), a, b, n, [None] * len(n))
        if len(words) > _FLUSH:
            yield rows([2] * len(words), pa.nulls(len(words), empty.type), list(words), [None] * len(words), list(words.values()), [texts[w] for w in words])
            words.clear(), texts.clear()
    if words:
        yield rows([2] * len(words), pa.nulls(len(words), empty.type), list(words), [None] * len(words), list(words.values()), [texts[w] for w in words])


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """Evidence of garbling, ``(kind, chave, word, was, n, m)``, in one pass over all texts beyond ASCII after one for copies."""
    src = df.select(F.col(key).alias("chave"), F.col(text).alias("texto")).where(F.octet_length("texto") > F.length("texto"))
    hashes = src.select("chave", "texto", F.xxhash64("texto").alias("h0"), F.xxhash64(F.lit(3), "texto").alias("h1"))
    copied = checkpoint(hashes.groupBy("h0", "h1").agg(F.count("*").alias("copias")).where("copias > 1"))
    copied = F.broadcast(copied) if copied.limit(SMALL + 1).count() <= SMALL else copied
    src = hashes.join(copied, ["h0", "h1"], "left").select("chave", "texto", F.coalesce("copias", F.lit(1)).alias("copias"))
    return checkpoint(src.mapInArrow(_scan, T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("chave", src.schema["chave"].dataType), T.StructField("word", T.StringType()), T.StructField("was", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.DoubleType())])))


def misread_words(evidence: DataFrame) -> DataFrame:
    """``(chave, word, was)``: words of each text for which a far more frequent word stood.

    Far more frequent by rows, or by different texts, so that copies of one garbled text do not hide it. Word counts are over
    all texts and pre-aggregated per task. Of several possible words the most frequent one.
    """
    counts = evidence.where("kind = 2").groupBy("word").agg(F.sum("n").alias("df"), F.round(F.sum("m"), 6).alias("texts"))
    maybe = evidence.where("kind = 1").select("word", "was").distinct()
    own = maybe.join(counts, "word").withColumnsRenamed({"df": "own", "texts": "own_texts"})
    goal = counts.select(F.col("word").alias("was"), "df", "texts")
    more = lambda a, b: (F.col(a) >= LEAST) & (F.col(a) >= RATIO * F.col(b))
    sure = own.join(goal, "was").where(more("df", "own") | more("texts", "own_texts"))
    sure = sure.groupBy("word").agg(F.max_by("was", F.struct("df", "was")).alias("was"))
    return evidence.where("kind = 1").select("chave", "word").distinct().join(sure, "word").select("chave", "word", "was")


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(chave)``: keys of the texts that hold a garbled character. Null, empty and ASCII texts never do.

    Texts are looked at whole. Repeated rows and keys come out once. Other columns are not read.
    """
    evidence = scan(df, key, text)
    return evidence.where("kind = 0").select("chave").unionByName(misread_words(evidence).select("chave")).distinct()


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(chave, original, restaurado)`` of each garbled text; what cannot be had back stays as it is."""
    evidence = scan(df, key, text)
    swaps = misread_words(evidence).groupBy("chave").agg(F.map_from_entries(F.collect_set(F.struct("word", "was"))).alias("swaps"))
    keys = evidence.where("kind = 0").select("chave").unionByName(swaps.select("chave")).distinct()
    rows = df.select(F.col(key).alias("chave"), F.col(text).alias("original")).join(keys, "chave", "left_semi").join(swaps, "chave", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = repair(t)[1] if t else t
                if s:
                    s = dict(s)
                    t = _WORD.sub(lambda m: s.get(m.group(), m.group()), t)
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["chave", "original", "restaurado"])

    kind = rows.schema["chave"].dataType.simpleString()
    return rows.mapInArrow(run, f"chave {kind}, original string, restaurado string")
