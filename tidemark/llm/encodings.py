"""Text that was decoded with a wrong encoding: found and restored by minimum description length.

Each word with a sign beyond ASCII is put through every chain "encode as what it was
read as, decode as what it was". What a reading costs is its size when compressed
with a zstandard dictionary of the language that suits it best, plus what the chain
costs; the cheapest reading wins, and without a clear gain the word stays. A replacement sign
(U+FFFD) is garbled text that cannot be restored.

Dictionaries, words and signs are learnt per language from all labelled documents, counted
where they are; detection reads every document whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, ship, written

# Encodings by their Python names.
SINGLE = ["cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15", "koi8_r", "koi8_u", "mac_roman", "cp437", "cp850", "cp852", "cp866", "cp1258"]
MULTI = ["gbk", "big5", "cp932", "euc_jp", "cp949"]
#: Every pair of them is tried; the more usual come first and give a reading its chain's name.
READ_AS = list(dict.fromkeys(["cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "cp866", *SINGLE, *MULTI]))
WRITTEN_IN = list(dict.fromkeys(["cp1251", "koi8_r", "koi8_u", "cp866", "iso8859_5", "cp1250", "iso8859_2", "cp852", "cp1252", "cp850", "cp437", "mac_roman", "cp1253", "iso8859_7", "cp1254", "iso8859_9", "cp1257", "cp1258", *SINGLE, *MULTI]))

#: Bits a chain costs: UTF-8 is rarely valid by chance, other encodings often are.
UTF8_BITS, OTHER_BITS = 6.0, 26.0
WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
SPLIT = re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=None)
def _table(name: str) -> dict[str, int]:
    """Sign to byte; bytes without a sign stand for the control code of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _bytes(text: str, name: str) -> bytes | None:
    if name in MULTI:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    table = _table(name)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _text(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def utf8_readings(text: str, raw: dict[str, bytes | None] | None = None) -> Iterator[tuple[str, str]]:
    """(other reading, chain) of a text that may be UTF-8 read as something else, each reading once."""
    seen = {text}
    raw = {} if raw is None else raw
    for name in [*SINGLE, *MULTI]:
        raw[name] = _bytes(text, name)
        if raw[name] is None:
            continue
        t = _text(raw[name], "utf-8")
        if t is None:
            t = _loose(raw[name])
        if t is not None and t not in seen:
            seen.add(t)
            yield t, f"utf-8 read as {name}"


def readings(text: str) -> Iterator[tuple[str, str, float]]:
    """(other reading, chain, bits of the chain) of a text, each reading once."""
    seen = {text}
    raw: dict[str, bytes | None] = {}
    for t, chain in utf8_readings(text, raw):
        seen.add(t)
        yield t, chain, UTF8_BITS
    if len(text) > 3:
        for a, b in (("utf-16-le", "utf-16-be"),):
            try:
                t = text.encode(a).decode(b)
            except UnicodeError:
                continue
            if t not in seen:
                seen.add(t)
                yield t, f"{b} read as {a}", OTHER_BITS
    tried: set[bytes] = set()
    for name in READ_AS:
        if raw[name] is None or raw[name] in tried:
            continue
        tried.add(raw[name])
        for other in WRITTEN_IN:
            if other != name and (t := _text(raw[name], other)) is not None and t not in seen:
                seen.add(t)
                yield t, f"{other} read as {name}", OTHER_BITS


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200:
        return "kana"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200:
        return "hangul"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "han"
    return unicodedata.name(c, "none").split()[0].lower() if c.isalpha() else "sign"


def _loose(raw: bytes) -> str | None:
    """UTF-8 with some bytes lost: what is whole must outweigh it; the rest become U+FFFD."""
    whole = sum(len(x) - 1 for x in SEQUENCE.findall(raw))
    if whole < 2:
        return None
    t = raw.decode("utf-8", "replace")
    return t if 2 * t.count("�") <= 3 * whole else None


SEQUENCE = re.compile(rb"[\xc3-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}")
LEAD = re.compile(r"[\s#/*>|│├└─-]+")
CORE = re.compile(r"^\W*(.*?)\W*$", re.S)
KNOWN_BITS, SIGN_BITS, STRANGE_BITS, LOST_BITS = 16.0, 6.0, 12.0, 12.0
#: No zstandard frame is smaller: descriptor, window, block header and a byte.
FRAME_BITS = 48.0


class Detector:
    """Language dictionaries, the words and the signs each language uses."""

    def __init__(self, dictionaries: dict[str, bytes], words: dict[str, set[str]], signs: dict[str, set[str]]):
        import zstandard

        self.words = set().union(*words.values()) if words else set()
        self.known = set().union(*signs.values()) if signs else set()
        self.press = {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self.press[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
        self.kept: dict[str, list[tuple[float, str, tuple[str, ...], bool]]] = {}
        self.of_script: dict[str, list[str]] = {}
        for lang, chars in signs.items():
            for s, n in Counter(script(c) for c in chars if ord(c) > 127 and c.isalpha()).items():
                if n >= 2:
                    self.of_script.setdefault(s, []).append(lang)

    def bits(self, text: str, most: float = float("inf")) -> float:
        """The size under the best language of the text's scripts; a known word has the size of its index. From most on a lower bound will do."""
        if text in self.words:
            return KNOWN_BITS
        core = CORE.match(text).group(1)
        if core and core in self.words:
            return KNOWN_BITS + SIGN_BITS * (len(text) - len(core))
        beyond = [c for c in text if ord(c) > 127]
        strange = STRANGE_BITS * sum((1 if ord(c) > 0x7FF else 3) for c in beyond if c not in self.known)
        if strange + FRAME_BITS >= most:
            return strange + FRAME_BITS
        langs = {lang for s in {script(c) for c in beyond if c.isalpha()} for lang in self.of_script.get(s, ())} or self.of_script.get("latin") or list(self.press)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        best = min((len(self.press[x](raw)) for x in langs), default=len(raw))
        return 8.0 * min(best, len(raw) + 4) + strange

    def _next(self, text: str, most: float) -> Iterator[tuple[float, str, str]]:
        """(bits with the chain, reading, chain) of the readings; from most bits on they are a lower bound."""
        for t, chain, price in readings(text):
            if not chain.startswith("utf") and not SPLIT.search(t):
                continue
            more = price + LOST_BITS * t.count("�")
            yield self.bits(t, most - more) + more, t, chain

    def _sure(self, text: str, chain: str) -> bool:
        """Whether a reading speaks for its chain: valid UTF-8, a known word, or signs of a script without spaces."""
        if chain.startswith("utf-8") or chain.startswith("utf-16") and all(c in self.known for c in text if ord(c) > 127):
            return True
        core = CORE.match(text).group(1)
        if core in self.words and sum(c.isalpha() for c in core) > 1:
            return True
        return sum(c in self.known and script(c) in ("han", "kana", "hangul") for c in text) > 1

    def restore(self, text: str) -> list[tuple[float, str, tuple[str, ...], bool]]:
        """(bits gained, reading, its chains, whether it speaks for them) of the readings that cost less than a word as it stands."""
        if text in self.kept:
            return self.kept[text]
        if len(self.kept) > 200_000:
            self.kept.clear()
        first = self.bits(text)
        out: dict[tuple[str, ...], tuple[float, str, bool]] = {}
        if first > KNOWN_BITS + UTF8_BITS:  # no reading costs less
            front, level = [(text, ())], 0
            while front:  # UTF-8 read wrongly once more is longer each time, so this ends
                ahead = []
                for t, chains in front:
                    for cost, new, chain in self._next(t, first):
                        way = (*chains, chain)
                        gain = first - cost - UTF8_BITS * level
                        if gain > 0:
                            out[way] = (gain, new, self._sure(new, chain))
                        if chain.startswith("utf-8") and SPLIT.search(new):
                            ahead.append((new, way))
                front, level = ahead, level + 1
        found = sorted(((g, t, w, s) for w, (g, t, s) in out.items()), key=lambda x: (-x[0], len(x[2]), x[2]))
        self.kept[text] = found
        return found

    def _leads(self, text: str, m: re.Match) -> bool:
        """Whether a word with unknown signs stands where a list's or a tree's signs do: before a line's first letter."""
        return any(ord(c) > 127 and c not in self.known for c in m.group()) and not LEAD.sub("", text[text.rfind("\n", 0, m.start()) + 1 : m.start()])

    def doc(self, text: str | None) -> tuple[bool, str | None, list[str]]:
        """(garbled, text as far as restored, chains used) of a document.

        Words share their chains: of the readings nearly as good as a word's best the one
        whose chain the document's other words speak for is taken.
        """
        if not text:
            return False, text, []
        gains: Counter = Counter()
        hits = []
        for m in WORD.finditer(text):
            found = self.restore(m.group())
            if found and self._leads(text, m):
                found = [(g, t, c, s or t in self.words and not any(x.isalnum() for x in t)) for g, t, c, s in found]
            if found:
                hits.append((m, found))
                for gain, _, chains, sure in found:
                    gains[chains] += gain if sure else 0.0
        used: Counter = Counter()
        parts, at = [], 0
        for m, found in hits:
            near = [x for x in found if x[0] >= 0.75 * found[0][0]] + [x for x in found if x[3]]
            _, t, chains, _ = max(near, key=lambda x: (gains[x[2]] > 0, x[0] >= 0.75 * found[0][0], gains[x[2]], x[0], x[2]))
            least = 0.0 if all(c.startswith("utf-8") for c in chains) else OTHER_BITS / 2
            if gains[chains] > least:
                parts += [text[at:m.start()], t]
                at = m.end()
                used.update(chains)
        parts.append(text[at:])
        lost = "�" in text
        return bool(used) or lost, "".join(parts), [c for c, _ in used.most_common()] + ["lost"] * lost


def _suspect(text: str, known: set[str], seen: dict[str, list[str]]) -> bool:
    """Whether a text should teach nothing: a word of it is UTF-8 of known signs read as another encoding."""
    if "�" in text:
        return True
    for w in set(WORD.findall(text)):
        if w not in seen:
            seen[w] = [t for t, _ in utf8_readings(w)]
        if any(all(c in known for c in t if ord(c) > 127) for t in seen[w]):
            return True
    return False


def _items(text: str, kind: str, kept: dict[str, set[str]]) -> set[str]:
    """What a text counts once each: usual signs, signs, words, and pieces of 1, 3 and 6 words whose own parts are kept."""
    if kind in ("usual", "sign"):
        return {c for c in text if ord(c) > 127 and (kind == "usual" or not 0x80 <= ord(c) < 0xA0)}
    w = re.findall(r"[^ \t\r\n]+", text)
    if kind == "word":
        return {y for x in w if SPLIT.search(x) for y in (x, CORE.match(x).group(1)) if SPLIT.search(y)}
    if kind == "1":
        return {" " + x for x in w}
    n, part = (3, 1) if kind == "3" else (6, 3)
    known = kept.get(str(part), set())
    held = [" " + " ".join(w[i : i + part]) in known for i in range(len(w) - part + 1)]
    return {" " + " ".join(w[i : i + n]) for i in range(len(w) - n + 1) if all(held[i : i + n : part])}


class Texts:
    """Texts by language as they are learnt from: counted, and thinned by a rule."""

    def __init__(self, texts: dict[str, list[str]]):
        self.texts, self.sizes = texts, {lang: len(t) for lang, t in texts.items()}

    def count(self, kinds: tuple[str, ...], least: dict[str, int], kept: dict[str, dict[str, set[str]]]) -> dict[tuple[str, str], Counter]:
        """(language, kind): how many texts have each item, for items of as many texts as ``least`` says."""
        out = {}
        for lang, most in least.items():
            for kind in kinds:
                n: Counter = Counter()
                for text in self.texts[lang]:
                    n.update(_items(text, kind, kept.get(lang, {})))
                out[lang, kind] = Counter({x: k for x, k in n.items() if k >= most})
        return out

    def thinned(self, make, arg) -> "Texts":
        """The texts for which make(arg)(language, text) holds."""
        keep = make(arg)
        return Texts({lang: [t for t in texts if keep(lang, t)] for lang, texts in self.texts.items()})

    def forget(self) -> None:
        """Drop what was kept of them."""


#: Items a task holds before it passes their counts on.
HELD_ITEMS = 200_000


def _counted(batches: Iterator[pd.DataFrame], kinds: tuple[str, ...], kept) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    own = kept.value

    def flush() -> pd.DataFrame:
        rows = pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "kind", "item", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            for kind in kinds:
                counts.update((lang, kind, x) for x in _items(text, kind, own.get(lang, {})))
            if len(counts) > HELD_ITEMS:
                yield flush()
    if counts:
        yield flush()


def _thinned(batches: Iterator[pd.DataFrame], make, arg) -> Iterator[pd.DataFrame]:
    keep = make(arg.value)
    for batch in batches:
        yield batch[[keep(lang, text) for lang, text in zip(batch["lang"], batch["text"])]]


class Table(Texts):
    """All rows (lang, text) of a table, where they are; only items of enough texts come to the driver."""

    def __init__(self, rows: DataFrame, name: str | None = None):
        self.rows, self.name = rows, name
        self.sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).collect()}

    def count(self, kinds, least, kept):
        out: dict[tuple[str, str], Counter] = {(lang, kind): Counter() for lang in least for kind in kinds}
        if not least:
            return out
        spark = self.rows.sparkSession
        given = spark.sparkContext.broadcast(kept)
        wanted = F.broadcast(spark.createDataFrame(sorted(least.items()), "lang string, least bigint"))
        counts = self.rows.join(wanted, "lang").select("lang", "text").mapInPandas(lambda it: _counted(it, kinds, given), "lang string, kind string, item string, n bigint")
        for r in counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).join(wanted, "lang").where("n >= least").select("lang", "kind", "item", "n").toLocalIterator():
            out[r["lang"], r["kind"]][r["item"]] = r["n"]
        return out

    def thinned(self, make, arg):
        given = self.rows.sparkSession.sparkContext.broadcast(arg)
        return Table(*written(self.rows.mapInPandas(lambda it: _thinned(it, make, given), "lang string, text string")))

    def forget(self):
        if self.name:
            discard(self.rows.sparkSession, self.name)


#: What fewer texts have teaches nothing, so neither does a language of fewer.
LEAST = 3


def _learn(texts: Texts, size: int) -> tuple[dict[str, bytes], dict[str, set[str]], dict[str, set[str]]]:
    least = {lang: max(LEAST, n // 100) for lang, n in sorted(texts.sizes.items()) if n >= LEAST}
    found = texts.count(("1", "word", "sign"), least, {})
    for kind, part in (("3", "1"), ("6", "3")):  # a piece is no more frequent than its parts
        found |= texts.count((kind,), least, {lang: {part: set(found[lang, part])} for lang in least})
    dictionaries, counts, signs = {}, {}, {}
    for lang in least:
        pieces = found[lang, "1"] + found[lang, "3"] + found[lang, "6"]
        kept = sorted(pieces, key=lambda w: (pieces[w] * len(w.encode()), w))
        dictionaries[lang] = "".join(kept).encode("utf-8", "surrogatepass")[-size:]
        counts[lang], signs[lang] = found[lang, "word"], set(found[lang, "sign"])
    # a word that is a far more frequent one read wrongly is no word
    everywhere: Counter = Counter()
    for c in counts.values():
        everywhere.update(c)
    known = {lang: {w for w, n in c.items() if not any(everywhere[t] >= 5 * everywhere[w] and sum(x.isalpha() for x in t) > 1 for t, _, _ in readings(w) if t in everywhere)} for lang, c in counts.items()}
    return dictionaries, known, signs


def _unsuspected(usual: dict[str, set[str]]):
    seen: dict[str, list[str]] = {}

    def keep(lang: str, text: str) -> bool:
        if len(seen) > 200_000:
            seen.clear()
        return not _suspect(text, usual.get(lang, set()), seen)

    return keep


def _ungarbled(model):
    detect = Detector(*model).doc
    return lambda lang, text: not detect(text)[0]


def learnt(texts: Texts, size: int = 100_000) -> tuple[dict[str, bytes], dict[str, set[str]], dict[str, set[str]]]:
    """Dictionaries, words and signs per language from its texts.

    Texts that are suspect, words that are others read wrongly and what is found in a few
    texts only are left out; then the texts found garbled are, and all is learnt again:
    so garbled texts teach nothing.
    """
    least = {lang: max(LEAST, n // 20) for lang, n in texts.sizes.items() if n >= LEAST}
    usual = {lang: set(c) for (lang, _), c in texts.count(("usual",), least, {}).items()}
    clean = texts.thinned(_unsuspected, usual)
    better = clean.thinned(_ungarbled, _learn(clean, size))
    clean.forget()
    model = _learn(better, size)
    better.forget()
    return model


def train(samples: dict[str, list[str]], size: int = 100_000) -> tuple[dict[str, bytes], dict[str, set[str]], dict[str, set[str]]]:
    """What is learnt from texts at hand."""
    return learnt(Texts(samples), size)


def language(label: str = "lang"):
    """A language label's first two letters, trimmed and in lower case."""
    return F.substring(F.lower(F.trim(F.col(label))), 1, 2)


def labelled(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(lang, text) of every text with a label of at least two letters."""
    return docs.select(language(label).alias("lang"), F.col(text).alias("text")).where((F.length("text") > 0) & (F.length("lang") == 2))


_detectors: dict[str, Detector] = {}


def _check(batches: Iterator[pd.DataFrame], model, key: str) -> Iterator[pd.DataFrame]:
    if key not in _detectors:
        _detectors.clear()
        _detectors[key] = Detector(*model.value)
    detect = _detectors[key].doc
    for batch in batches:
        found = [detect(t) for t in batch.pop("_text")]
        batch["garbled"] = [x for x, _, _ in found]
        batch["restored"] = [t for _, t, _ in found]
        batch["chains"] = [c for _, _, c in found]
        yield batch


def wrong_encodings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, garbled, restored, chains) of every document.

    garbled: a stretch of the text was decoded with a wrong encoding. restored: the
    text with each such stretch as it must have been, as far as it can be told;
    otherwise the text itself. chains: the wrong decodings, most frequent first, with
    "lost" where U+FFFD stands for bytes that are gone. Null and empty texts are not
    garbled and stay as they are; repeated rows give repeated rows; texts are read
    whole, however long. Without labelled texts only what UTF-8 proves is found. No
    shuffle of the texts: the model (100 kB and the frequent words of each language) goes to
    the rows, and is learnt where they are, from all that have a label.
    """
    import uuid

    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(learnt(Table(labelled(docs, text, label))))
    key = uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).alias("_text")).mapInPandas(
        lambda it: _check(it, model, key), f"`{doc_id}` {kind}, garbled boolean, restored string, chains array<string>")
