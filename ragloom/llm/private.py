"""Personal data in whole texts: four patterns, and spans that a character tagger adds to them.

One scan finds the patterns' spans, and the regions around every digit and at sign (spelt ones in brackets too), without
which no span of these kinds can be. The tagger (a bidirectional LSTM with CRF transitions) learns from labelled spans:
those of a bounded sample of the regions, and spans made by rules in forms that the patterns miss, put into these
regions' text. Regions are then decoded in overlapping windows. A span that an inner border of a window cuts is left to
the neighbour; all windows' spans of a text are reconciled together, as the choice of spans that do not overlap whose
marginals add up to most; the patterns' spans are fixed. An added span must also pass its kind's check (digits, Luhn).
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.scratch import stored
from ragloom.llm.tagger import Tagger, codes
from ragloom.llm.textwords import buffers, trim

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Characters of context around a digit or at sign; window and the step between windows; windows decoded together.
MARGIN, WINDOW, STEP, TOGETHER = 40, 96, 48, 512
#: Distinct regions that the tagger is trained on, at most (by hash), characters of each; sequences made for each of them, and in all at least.
TRAIN_REGIONS, TRAIN_CHARS, MADE, MADE_LEAST = 1_500, 96, 2, 4_000
#: Least mean marginal of an added span.
SURE = 0.5

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[(\[{]\s{0,2}at\s{0,2}[)\]}]", re.I)
_SPELT_DOT = r"\s{0,2}(?:\.|[(\[{]\s{0,2}(?:dot|\.)\s{0,2}[)\]}])\s{0,2}"
_ANY_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s{0,2}(?:@|[(\[{]\s{0,2}(?:at|@)\s{0,2}[)\]}])\s{0,2}[A-Za-z0-9-]+(?:" + _SPELT_DOT + r"[A-Za-z0-9-]+)+", re.I)
_ANY_IP = re.compile(r"([0-9]{1,3})" + (_SPELT_DOT + "([0-9]{1,3})") * 3)
_ANY_CARD = re.compile(r"[0-9](?:[\x20./-]?[0-9]){13,18}")
_ANY_PHONE = re.compile(r"[+(0-9][\x20()./0-9-]*[0-9]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64, 40, 91, 123]] = True


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from sign to sign: whatever precedes one in local characters is its local part, so no start is tried twice
    end, at = 0, text.find("@")
    while at >= 0:
        head = text[end:at]
        size = len(head) - len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if size else None
        if found:
            yield at - size, found.end()
            end = found.end()
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))


def patterned(text: str, checked: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start and kind: each pattern's leftmost matches that do not overlap. Unchecked: by form alone."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if not checked or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and (not checked or luhn(digits)):
            out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((PHONE, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def passes(kind: int, text: str) -> bool:
    """Whether an added span has its kind's form and check."""
    if kind == EMAIL:
        return bool(_ANY_EMAIL.fullmatch(text))
    if kind == IP:
        found = _ANY_IP.fullmatch(text)
        return bool(found) and all(int(p) <= 255 for p in found.groups())
    if kind == CARD:
        return bool(_ANY_CARD.fullmatch(text)) and luhn(_digits(text))
    plain = len(_digits(text)) == len(text)
    return bool(_ANY_PHONE.fullmatch(text)) and not plain and 10 <= len(_digits(text)) <= 15


def regions(text: str, margin: int = MARGIN, piece: int = 1 << 20) -> list[tuple[int, int]]:
    """Stretches of the text within `margin` characters of a digit, an at sign or a spelt one."""
    out: list[list[int]] = []
    spelt = sorted(m.start() for m in _SPELT.finditer(text))
    for a in range(0, len(text), piece):
        points = np.frombuffer(text[a : a + piece].encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((points - 48 < 10) | (points == 64)) + a
        here = [p for p in spelt if a <= p < a + piece]
        at = np.union1d(at, here).astype(np.int64) if here else at
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) > 2 * margin) + 1
        for first, last in zip(at[np.concatenate([[0], cut])].tolist(), at[np.concatenate([cut - 1, [len(at) - 1]])].tolist(), strict=True):
            begin, end = max(0, first - margin), min(len(text), last + margin + 1)
            if out and begin <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([begin, end])
    return [(a, b) for a, b in out]


# labelled spans


def _grouped(digits: str, sizes: list[int], by: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(digits[at : at + s])
        at += s
    return by.join([*out, *([digits[at:]] if digits[at:] else [])])


class Maker:
    """Seeded spans of each kind, in the patterns' forms and in others, and numbers that are none."""

    def __init__(self, seed: int = 17):
        self.draw = np.random.Generator(np.random.PCG64(seed))

    def number(self, n: int) -> str:
        return "".join(map(str, self.draw.integers(0, 10, n)))

    def name(self, least: int = 2, most: int = 9) -> str:
        return "".join(self.draw.choice(list(string.ascii_lowercase), int(self.draw.integers(least, most + 1))))

    def one(self, *of):
        return of[int(self.draw.integers(0, len(of)))]

    def made(self, kind: int) -> str:
        if kind == EMAIL:
            local = self.one(self.name(), f"{self.name()}.{self.name()}", f"{self.name()}.{self.number(2)}", f"{self.name()}_{self.name()}", f"{self.name().title()}{self.number(3)}")
            dot = self.one(".", ".", ".", " [dot] ", " (dot) ", "[.]")
            at = self.one("@", "@", " (at) ", " [at] ", "(at)", "[at]", " @ ", "[@]", " {at} ", " (AT) ")
            return local + at + dot.join([self.one(self.name(), f"{self.name()}{self.number(1)}", f"{self.name()}-{self.name()}") for _ in range(int(self.draw.integers(1, 3)))] + [self.one("com", "org", "net", "de", "fr", "es", "io", "co", self.name(2, 4))])
        if kind == IP:
            return self.one(".", ".", "[.]", "(.)", " . ").join(str(int(x)) for x in self.draw.integers(0, 256, 4))
        if kind == CARD:
            digits = self.number(int(self.one(16, 16, 16, 14, 15, 17, 18, 19)))
            return _grouped(digits, [4, 6, 5] if len(digits) == 15 else [4, 4, 4, 4], self.one("", "", " ", "-", ".", "/"))
        area, first, last = self.number(3), self.number(3), self.number(4)
        land = self.number(int(self.draw.integers(1, 4))).lstrip("0") or "1"
        body = self.one(f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{area} {first} {last}", f"({area}) {first} {last}", f"({area}){first}-{last}", f"{area}/{first}-{last}", f"({area}) {first}.{last}")
        return self.one("", "", f"+{land} ", f"+{land}-", f"00{land} ", f"+{land}", "1-", "1 ") + body

    def other(self) -> str:
        """Numbers and signs that are none of the kinds."""
        n = lambda a, b: str(int(self.draw.integers(a, b)))
        return self.one(
            f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2100)}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"{n(1900, 2100)}-0{n(1, 9)}-{n(10, 29)} {n(10, 24)}:{n(10, 60)}",
            f"{n(0, 1000)}.{n(0, 100)}", f"{n(1, 1000)},{self.number(3)}.{self.number(2)}", self.number(int(n(1, 10))), self.number(int(n(21, 40))), f"{n(0, 10)}.{n(0, 20)}.{n(0, 20)}", f"@{self.name()}", f"{n(1900, 2030)}-{n(1900, 2030)}", f"{n(1, 99)}%", f"${n(1, 9999)}.{self.number(2)}",
            f"{self.number(2)}x{self.number(2)}", f"#{self.number(5)}", f"978-{self.number(1)}-{self.number(4)}-{self.number(4)}-{self.number(1)}", f'"{"".join(self.draw.choice(list("0123456789abcdef"), int(n(24, 40))))}"', f"{n(1, 40)}, {n(1, 40)}, {n(1, 40)} and {n(41, 99)}", f"{self.name()} @ {self.name()}", f"(at {self.name()})", f"{self.number(4)} {self.number(2)}",
        )


def training_rows(texts: list[str], made: int | None = None, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, labelled spans): each text with the spans of its patterns by form, and `made` copies of it into which made spans and other numbers are put."""
    maker, out = Maker(seed), []
    made = max(MADE, -(-MADE_LEAST // max(1, len(texts)))) if made is None else made
    for text in texts:
        labels = patterned(text, checked=False)
        out.append((text, _apart(labels)))
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in labels:
            taken[a : b + 1] = True
        gaps = [m.end() for m in re.finditer(r"\s", text) if not taken[m.end()]] or [0]
        for _ in range(made):
            at = int(maker.one(*gaps))
            line, spans = text[max(0, at - 40) : at], []
            for k in range(int(maker.one(1, 1, 2))):
                line += maker.one(" ", " ", ", ", ": ", "\n", "(") if k or line and maker.draw.random() < 0.2 else ""
                kind = int(maker.draw.integers(0, 4)) if maker.draw.random() < 0.65 else None
                put = maker.other() if kind is None else maker.made(kind)
                if kind is not None:
                    spans.append((kind, len(line), len(line) + len(put)))
                line += put
            line += maker.one(" ", " ", ". ", ", ", "\n", ") ", "!! ", "") + text[at : at + 40]
            # what the context holds by itself is labelled as well, but for what touches a made span
            near = [s for s in patterned(line, checked=False) if all(s[2] + 1 < a or s[1] > b + 1 for _, a, b in spans)]
            out.append((line, _apart(sorted(spans + near, key=lambda s: s[1]))))
    return out


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans by start, each that begins after the end of the one kept before it."""
    out: list[tuple[int, int, int]] = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside; of kind k, 2k + 1 at the first character and 2k + 2 at the others."""
    out = np.zeros(size, np.uint8)
    for kind, a, b in spans:
        out[a:b] = 2 * kind + 2
        out[a] = 2 * kind + 1
    return out


def trained(rows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 3) -> Tagger:
    """The tagger of labelled spans; texts longer than a window are cut to one at a seeded place."""
    draw, lines, tags = np.random.Generator(np.random.PCG64(seed)), [], []
    for text, spans in rows:
        a = int(draw.integers(0, max(1, len(text) - WINDOW + 1)))
        if text:
            lines.append(codes(text)[a : a + WINDOW])
            tags.append(tags_of(len(text), spans)[a : a + WINDOW])
    out = Tagger.fresh(2 * len(KINDS) + 1)
    for k in range(len(KINDS)):  # a span goes on only with its own kind
        out.change[[j for j in range(9) if j not in (2 * k + 1, 2 * k + 2)], 2 * k + 2] = -8
    if lines:
        out.train(lines, tags)
    return out


# decoding


def windows(start: int, text: str) -> Iterator[tuple[int, str, bool, bool]]:
    """(place, characters, cut at its left, at its right) of overlapping windows."""
    for a in range(0, max(1, len(text) - WINDOW + STEP), STEP):
        yield start + a, text[a : a + WINDOW], a > 0, a + WINDOW < len(text)


def reconciled(spans: list[tuple[float, int, int, int]], fixed: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of (weight, kind, start, end), those of most weight together that overlap neither each other nor a fixed span."""
    best: dict[tuple[int, int, int], float] = {}
    for p, *s in spans:
        if not any(a < s[2] and s[1] < b for _, a, b in fixed):
            best[tuple(s)] = max(p, best.get(tuple(s), 0.0))
    line = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in line]
    sums: list[tuple[float, int]] = [(0.0, -1)]  # of the first k spans: most weight, whether the last is taken
    for k, s in enumerate(line):
        before = int(np.searchsorted(ends[:k], s[1], "right"))
        take = sums[before][0] + best[s]
        sums.append((take, before) if take > sums[k][0] else (sums[k][0], -1))
    out, k = [], len(line)
    while k:
        if sums[k][1] >= 0:
            out.append((best[line[k - 1]], *line[k - 1]))
            k = sums[k][1]
        else:
            k -= 1
    return out[::-1]


def _runs(tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, mean marginal) of the spans of a path."""
    begin = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (np.concatenate([[0], tags[:-1]]) == 0)))
    for a in begin.tolist():
        kind, b = (int(tags[a]) - 1) // 2, a + 1
        while b < len(tags) and tags[b] == 2 * kind + 2:
            b += 1
        yield kind, a, b, float(sure[a:b].mean())


def added(tagger: Tagger, texts: list[list[tuple[int, str]]], fixed: list[list[tuple[int, int, int]]]) -> list[list[tuple[float, int, int, int]]]:
    """Per text (its regions as (start, characters), and its fixed spans): the spans that the tagger adds."""
    cut = [(k, *w) for k, found in enumerate(texts) for start, text in found for w in windows(start, text)]
    cut.sort(key=lambda w: len(w[2]))
    out: list[list] = [[] for _ in texts]
    for i in range(0, len(cut), TOGETHER):
        part = cut[i : i + TOGETHER]
        for (k, at, text, left, right), (tags, sure) in zip(part, tagger.decode([codes(w[2]) for w in part]), strict=True):
            for kind, a, b, p in _runs(tags, sure):
                if not (left and a == 0 or right and b == len(text)) and p >= SURE and passes(kind, text[a:b]):
                    out[k].append((p, kind, at + a, at + b))
    return [reconciled(s, f) for s, f in zip(out, fixed, strict=True)]


# on Spark

_BASE = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_REGIONS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("text", T.StringType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _named(part: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(T.StructField(n, part.schema[n].dataType) for n in names), *(T.StructField(n, t) for n, t in more)])


def scanned(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """Carried columns c0, c1 …, the patterns' spans `base` and the `regions` to decode, of every row."""
    names = [f"c{i}" for i in range(len(carry))]
    part = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    schema = _named(part, names, ("base", _BASE), ("regions", _REGIONS))

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            data, offsets = buffers(column)
            hits = np.concatenate([[0], np.cumsum(_TRIGGER[data[offsets[0] : offsets[-1]]])])
            some = np.flatnonzero(hits[offsets[1:] - offsets[0]] > hits[offsets[:-1] - offsets[0]])
            base, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for k in some.tolist():
                text = column[k].as_py()
                base[k] = [{"kind": s, "start": a, "end": b} for s, a, b in patterned(text)]
                found[k] = [{"start": a, "text": text[a:b]} for a, b in regions(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(base, _arrow(_BASE)), pa.array(found, _arrow(_REGIONS))], schema.names)
            trim()

    return part.mapInArrow(run, schema)


def sampled(scan: DataFrame, regions: int = TRAIN_REGIONS) -> list[str]:
    """The first characters of about `regions` distinct regions, those of least hash; never more."""
    line = scan.select(F.explode("regions.text").alias("t")).select(F.substring("t", 1, TRAIN_CHARS).alias("t"))
    many = line.agg(F.approx_count_distinct("t", 0.05).alias("n")).first()["n"]
    key, room = F.pmod(F.xxhash64("t"), F.lit(1 << 40)), 1 << 40
    below = min(room, int(room * 1.2 * regions / max(1, many)))
    return [r["t"] for r in sorted(line.where(key < below).select("t", key.alias("k")).distinct().collect(), key=lambda r: (r["k"], r["t"]))][:regions]


def detected(scan: DataFrame, tagger: Tagger, carry: list[str], base: str = "base", spans: str = "spans") -> DataFrame:
    """Of `scanned` rows: the columns in `carry`, the patterns' spans and all spans, as arrays of (kind, start, end, p) by start and kind."""
    names = [f"c{i}" for i in range(len(carry))]
    schema = _named(scan, names, ("base", _SPANS), ("spans", _SPANS))

    def rows(found):
        return [{"kind": KINDS[k], "start": a, "end": b, "p": p} for p, k, a, b in sorted(found, key=lambda s: (s[2], s[1]))]

    def run(batches):
        for batch in batches:
            fixed = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("base").to_pylist()]
            texts = [[(r["start"], r["text"]) for r in x] for x in batch.column("regions").to_pylist()]
            plain = [[(1.0, *s) for s in x] for x in fixed]
            whole = [x + y for x, y in zip(plain, added(tagger, texts, fixed), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([rows(x) for x in y], _arrow(_SPANS)) for y in (plain, whole))], schema.names)
            trim()

    out = scan.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), F.col("base").alias(base), F.col("spans").alias(spans))


def found(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, base: str = "base", spans: str = "spans", learn: Callable[[list[str]], Tagger] = lambda texts: trained(training_rows(texts))) -> DataFrame:
    """Every row (columns in `carry`, all by default) with `base` and `spans`: kind, start, end (code points, end exclusive) and p.

    Null and empty texts have none. Spans of the patterns have p 1 and are among `spans`. The tagger is learnt from the
    table's own regions; without any nothing is added. Rows that repeat are rows of their own. Columns named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (base, spans)]
    scan = stored(scanned(docs, keep, text_col), "private-scan")
    return detected(scan, learn(sampled(scan)), keep, base, spans)


def redacted(rows: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """The rows of `found`, in `text_col` each stretch that spans cover replaced by its first span's kind in brackets."""
    names = rows.columns

    def masked(text: str, found: list[dict]) -> str:
        out, at = [], 0
        for s in found:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = [t if t is None or not s else masked(t, s) for t, s in zip(batch.column(text_col).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in rows.schema]))
