"""Personal information in text: candidates, a skip-chain conditional random field over them, and placeholders."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OTHER, FIRST, SURNAME = 0, 1, 2
#: Separators between neighbouring words.
BLANK, HYPHEN, COMMA, BREAK = 0, 1, 2, 3
BUCKETS = 1 << 17
#: Log-odds for a repeated word to keep its label, before anything is learned: texts that repeat a name are rare.
SKIP_PRIOR = (0.0, 1.5, 1.5)

_SEP = r"[     ]"
_DASH = r"[-‐‑‒–]"
_JOIN = rf"(?:{_SEP}?(?:{_DASH}|[./]){_SEP}?|{_SEP})"

# --- forms with a fixed writing -------------------------------------------------------------------------------------

_AT = rf"(?:{_SEP}?[@＠]{_SEP}?|{_SEP}?[\[({{<]{_SEP}?at{_SEP}?[\])}}>]{_SEP}?)"
_DOT = rf"(?:\.|{_SEP}?[\[({{]{_SEP}?dot{_SEP}?[\])}}]{_SEP}?|{_SEP}dot{_SEP})"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_LOCAL = r"(?<![\w.+@-])[\w](?:[\w.+%'-]*[\w])?"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}(?:{_LABEL}{_DOT})+[^\W\d_]{{2,}}|{_SEP}at{_SEP}(?:{_LABEL}(?:{_SEP}dot{_SEP}))+[^\W\d_]{{2,}})(?![\w@])", re.I)

#: What any address has; most texts have none of these and needn't be searched for one.
_AT_SIGN = re.compile(rf"[@＠]|[\[({{<]{_SEP}?at{_SEP}?[\])}}>]|{_SEP}at{_SEP}[^\s]+{_SEP}dot{_SEP}", re.I)

_EXT = rf"(?:,?{_SEP}?(?:ext|extension|x|durchwahl|nebenstelle|int)\.?{_SEP}?\d{{1,6}})?"
PHONE = re.compile(
    rf"(?<![\w.+#/-])(?:"
    rf"(?:(?:\+|00)?1{_JOIN}?)?(?:\(\d{{3}}\){_SEP}?|\d{{3}}{_JOIN})\d{{3}}{_JOIN}\d{{4}}"  # North America
    rf"|(?:\+|00)1\d{{10}}"
    rf"|(?:\+|00)[2-9]\d{{0,2}}(?:{_JOIN}?\(0\){_JOIN}?|{_JOIN})?\d[\d]*(?:{_JOIN}\d+){{0,5}}"  # with a country code
    rf"|\(?0[1-9]\d{{0,4}}\)?{_JOIN}{_SEP}?\d{{2,8}}(?:{_JOIN}\d{{2,8}}){{0,4}}"  # with a trunk prefix
    rf"|\(0\d{{2,4}}\){_SEP}?\d{{3,8}}(?:{_JOIN}\d{{2,8}}){{0,3}}"
    rf"){_EXT}(?![\w]|[.-]\d)",
    re.I,
)
_D = r"\d"
NATIONAL_ID = re.compile(
    rf"(?<![\w.+-])(?:"
    rf"{_D}{{3}}(?P<s>[- ‑–]){_D}{{2}}(?P=s){_D}{{4}}"  # social security
    rf"|[A-Z]{{2}}{_SEP}?{_D}{{2}}{_SEP}?{_D}{{2}}{_SEP}?{_D}{{2}}{_SEP}?[A-D]"  # insurance
    rf"|[XYZ]-?{_D}{{7}}-?[A-Z]"  # foreigners
    rf"|{_D}{{2}}\.{_D}{{3}}\.{_D}{{3}}-?[A-Z]|{_D}{{8}}-?[A-Z]"  # identity card
    rf"|{_D}{{2}}{_SEP}{_D}{{3}}{_SEP}{_D}{{3}}{_SEP}{_D}{{3}}"  # tax
    rf"|[A-Z]{{1,2}}{_D}{{7}}"  # passport
    rf")(?![\w]|[.-]\d)",
    re.I,
)
#: An eleven- or nine-digit number, or one with letters in front, is one only beside such a word.
BARE_ID = re.compile(r"(?<![\w.+=-])\d{9}(?:\d\d)?(?![\w]|[.-]\d)")
_ID_CUES = re.compile(r"(?:\bssn|\bnif|\bnie|\bdni|\bid(?: no\.?)?|passport|pasaporte|ausweis|tax(?: ?id)?|steuer\w*|identity|documento|insurance|nino|social security)\W{0,4}(?:\w+\W{0,4}){0,2}$", re.I)

_STREET = r"(?:St|Street|Rd|Road|Ave|Avenue|Ln|Lane|Dr|Drive|Blvd|Boulevard|Way|Ct|Court|Close|Terrace|Place|Pl|Square|Sq|Row|Hill|Walk|Crescent|Gardens|Parade|Quay|Mews|Highway|Hwy|Grove|Park)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_UNIT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Floor|Room|Rm)"
_B = _SEP
ADDRESS = re.compile(
    rf"(?<![\w.,:/=-])(?:"
    rf"(?:(?i:{_UNIT})\.?{_B}\d+[A-Za-z]?,{_B})?\d{{1,5}}[A-Za-z]?{_B}(?:{_CAP}{_B}){{1,3}}(?i:{_STREET})\b"
    rf"(?:,?{_B}(?i:{_UNIT})\.?{_B}?#?\d+[A-Za-z]?\b|,?{_B}?\#\d+[A-Za-z]?\b|,?{_B}\d+(?:st|nd|rd|th){_B}floor\b)?"
    rf"|(?i:calle|avda\.?|avenida|plaza|paseo|camino|ronda|c/){_B}?(?:(?:de|del|la|las|los|el){_B})*(?:{_CAP}{_B}?)(?:{_B}?{_CAP}){{0,3}},?{_B}?(?:(?i:n\.?[ºo°]|núm\.?){_B}?)?\d{{1,4}}\b(?:,{_B}\d{{1,2}}[ºª°]{_B}?[A-Za-z]?\b)?(?:,{_B}(?i:piso|puerta|planta|esc\.?){_B}\w+)*"
    rf"|{_CAP}(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm|STRASSE|STRAßE|GASSE|WEG|ALLEE|PLATZ|STR\.){_B}\d{{1,4}}{_B}?[A-Za-z]?\b"
    rf"|{_CAP}{_B}(?i:straße|strasse|str\.|allee|platz|weg|gasse){_B}\d{{1,4}}{_B}?[A-Za-z]?\b"
    rf"|(?i:am|an der|an den|im|zum|zur|auf der|auf dem|in der|unter den){_B}(?:{_CAP}{_B}){{1,2}}\d{{1,4}}[A-Za-z]?\b"
    rf")(?:,{_B}(?:\d{{1,2}}\.{_B}(?:Stock|OG|Etage)|(?:EG|DG|Whg\.?{_B}\d+|Hinterhaus))\b)*",
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_GAPS = {"-": HYPHEN, "‐": HYPHEN, "‑": HYPHEN}
_ONLY_BLANKS = re.compile(rf"{_SEP}{{1,3}}\Z")
_COMMA = re.compile(rf",{_SEP}{{1,2}}\Z")


@dataclass
class Word:
    start: int
    end: int  # an initial's full stop is part of it
    low: str
    shape: int  # 0 lower, 1 capital, 2 upper, 3 initial, 4 mixed


class Words:
    """The words of a text outside the taken spans, which are in order. Most are never looked at beyond their letters."""

    def __init__(self, text: str, taken: list[tuple[int, int]] = ()):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        if taken:
            starts, ends = [a for a, _ in taken], [b for _, b in taken]
            out = []
            for a, b in self.spans:
                k = bisect_right(ends, a)
                if k == len(starts) or b <= starts[k]:
                    out.append((a, b))
            self.spans = out
        self._made: dict[int, Word] = {}

    def __len__(self) -> int:
        return len(self.spans)

    def __iter__(self) -> Iterator[Word]:
        return (self[i] for i in range(len(self.spans)))

    def __getitem__(self, i: int) -> Word:
        if i < 0:
            i += len(self.spans)
        got = self._made.get(i)
        if got is None:
            got = self._made[i] = self._make(*self.spans[i])
        return got

    def _make(self, a: int, b: int) -> Word:
        w = self.text[a:b]
        if b - a == 1:
            shape = 3 if w.isupper() else 0
            if shape == 3 and self.text[b : b + 1] == ".":
                b += 1
        else:
            shape = 0 if w.islower() else 2 if w.isupper() else 1 if w[0].isupper() and w[1:].islower() else 4
        return Word(a, b, w.casefold() + "." * (b - a - len(w)), shape)


def _neighbours(ws: Words) -> Iterator[tuple[Word, Word]]:
    return ((ws[i], ws[i + 1]) for i in range(len(ws) - 1))


def gap(text: str, a: Word, b: Word) -> int:
    """The kind of separator between neighbours."""
    if b.start - a.end > 3:
        return BREAK
    s = text[a.end : b.start]
    if s in _GAPS:
        return _GAPS[s]
    if s == "" and a.shape == 3 or _ONLY_BLANKS.match(s):
        return BLANK
    return COMMA if _COMMA.match(s) else BREAK


def fixed_forms(text: str) -> list[tuple[int, int, str, float]]:
    """Candidates (start, end, kind, prior log-odds) of the kinds with a fixed writing; they may overlap, and may be none."""
    out = []
    if _AT_SIGN.search(text):
        out += [(*m.span(), "email", 6.0) for m in EMAIL.finditer(text)]
    for m in NATIONAL_ID.finditer(text):
        out.append((*m.span(), "national_id", 4.0 + 3.0 * bool(_ID_CUES.search(text, max(0, m.start() - 40), m.start()))))
    for m in BARE_ID.finditer(text):
        out.append((*m.span(), "national_id", 3.0 if _ID_CUES.search(text, max(0, m.start() - 40), m.start()) else -3.0))
    for m in PHONE.finditer(text):
        digits = sum(map(str.isdigit, re.split(r"(?i)[a-z]", m.group())[0]))
        out.append((*m.span(), "phone", 5.0 if 9 <= digits <= 15 else -5.0))
    out += [(*m.span(), "address", 5.0) for m in ADDRESS.finditer(text)]
    return out


# --- the field ------------------------------------------------------------------------------------------------------


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode()) & (BUCKETS - 1)


def lexical(low: str) -> list[str]:
    return [f"w={low}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"s5={low[-5:]}", f"p3={low[:3]}", f"p4={low[:4]}"]


def contextual(text: str, ws: Words, i: int, gaps: list[int]) -> list[str]:
    w = ws[i]
    left = gaps[i - 1] if i else BREAK
    right = gaps[i] if i + 1 < len(ws) else BREAK
    before = ws[i - 1].low if i and w.start - ws[i - 1].end <= 4 else "|"
    two = ws[i - 2].low if i > 1 and ws[i - 1].start - ws[i - 2].end <= 2 else "|"
    after = ws[i + 1].low if i + 1 < len(ws) and ws[i + 1].start - w.end <= 4 else "|"
    mark = text[w.start - 2 : w.start].strip()[-1:] if w.start else ""
    first = w.start == 0 or text[w.start - 1] in "\r\n"
    last = w.end == len(text) or text[w.end] in "\r\n"
    return [f"shape={w.shape}", f"l={left},{w.shape}", f"r={right},{w.shape}", f"b={before}", f"bb={two} {before}", f"a={after}", f"m={mark}", f"line={first}{last}{w.shape}"]


def span_context(text: str, a: int, b: int, kind: str) -> list[str]:
    """What a candidate looks like and what stands around it."""
    before = _CONTEXT.findall(text, max(0, a - 40), a)[-2:]
    after = _CONTEXT.search(text, b, b + 24)
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", text[a : min(b, a + 24)]))
    one = before[-1].lower() if before else "|"
    return [f"{kind}", f"{kind} form={form}", f"{kind} b={one}", f"{kind} bb={' '.join(before).lower()}", f"{kind} a={after.group().lower() if after else '|'}"]


_CONTEXT = re.compile(r"[^\W\d_]+|[=:@/#<\"']")
_PLAIN = re.compile(r"[\W_]+")


def _same(text: str, a: int, b: int, kind: str) -> tuple[str, str]:
    """Two candidates with this in common are the same thing, however they are written."""
    return kind, _PLAIN.sub("", text[a:b]).lower()


#: Words after which a person is named, in the languages of the corpus; they give the first examples to train on.
BYLINES = re.compile(
    r"(?:\bsigned-off-by:|\breported by|\bthanks to|\bassigned to|\bowner:|\bauthor:|\bcc|\bi asked|\bwritten by|\bfirmado:|\bresponsable:|\bverantwortlich:|\bgemeldet von|\bcomunicó|\bpregunté a|\bich habe)[  ]+(?:(?:dr|mr|mrs|ms|prof|sra?|frau|herr)\.?[  ]+)?"
    r"|\b(?:dr|mr|mrs|ms|prof|sra|sr)\.[  ]+|\b(?:frau|herr|doña)[  ]+",
    re.I,
)
_N = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{2,}"
_DIRECT = re.compile(rf"(?P<f>{_N}(?:-{_N})?|[A-Z]\.)(?: (?:[A-Z]\.|{_N}))?? (?P<s>{_N}(?:[ -]{_N})?)(?![\w-]| {_N})")
_TURNED = re.compile(rf"(?P<s>{_N}(?:[ -]{_N})?), (?P<f>{_N}(?:-{_N})?)(?![\w-])")


_TITLES = {"dr", "mr", "mrs", "ms", "prof", "sr", "sra", "frau", "herr", "don", "doña"}


@dataclass
class Read:
    """A text with its candidates of fixed writing, those that the priors alone choose, and the words outside them."""

    text: str
    found: list[tuple[int, int, str, float]]
    taken: list[tuple[int, int, str]]
    words: Words

    @classmethod
    def of(cls, text: str) -> "Read":
        found = fixed_forms(text)
        taken = resolve(found)
        return cls(text, found, taken, Words(text, [(a, b) for a, b, _ in taken]))


def _lexicon(texts: list[Read], rounds: int = 3) -> dict[str, int]:
    """Words seen in names behind bylines, with their role; words that stand elsewhere far more often are left out.

    Then, a few times over, words that mostly stand where a known name leaves room for the other part of it.
    """
    roles: dict[str, Counter] = defaultdict(Counter)
    everywhere: Counter = Counter()
    capital: Counter = Counter()
    beside: list[tuple[str, str, int]] = []
    for read in texts:
        text, ws = read.text, read.words
        everywhere.update(w.low for w in ws)
        capital.update(w.low for w in ws if w.shape in (1, 2))
        for v, w in _neighbours(ws):
            if w.start - v.end <= 2 and (w.shape in (1, 2) or v.shape in (1, 2)) and (g := gap(text, v, w)) != BREAK:
                beside.append((v.low, w.low, g))
        for cue in BYLINES.finditer(text):
            m = _TURNED.match(text, cue.end()) or _DIRECT.match(text, cue.end())
            if m:
                for role, group in ((FIRST, "f"), (SURNAME, "s")):
                    for part in re.split(r"[ -]", m[group]):
                        if len(part) > 2:
                            roles[part.casefold()][role] += 1
    known = {w: c.most_common(1)[0][0] for w, c in roles.items() if sum(c.values()) >= 2 and sum(c.values()) >= 0.1 * everywhere[w]}
    for _ in range(rounds):
        fits: dict[str, Counter] = defaultdict(Counter)
        for v, w, g in beside:
            if known.get(w) == SURNAME and v not in known and g == BLANK:
                fits[v][FIRST] += 1
            if w not in known and (g == BLANK and known.get(v) == FIRST or g == HYPHEN and known.get(v) == SURNAME):
                fits[w][SURNAME] += 1
            if g == COMMA and known.get(v) == SURNAME and w not in known:
                fits[w][FIRST] += 1
            if g == COMMA and known.get(w) == FIRST and v not in known:
                fits[v][SURNAME] += 1
        new = {
            w: c.most_common(1)[0][0]
            for w, c in fits.items()
            if len(w) > 2 and w not in _TITLES and c.most_common(1)[0][1] >= 0.4 * everywhere[w] and capital[w] >= 0.6 * everywhere[w]
        }
        if not new:
            break
        known |= new
    return known


class Field:
    """A skip-chain field over a text's words and the candidates of fixed writing.

    A word is other, first name (or initial) or surname. Unary potentials come from its form and context, chain
    potentials join neighbours by their separator, and skip potentials join repeated words, each occurrence with the
    next one. A candidate (an address, a number, ...) is of its kind or not: its unary potential is the prior of its
    form and what its context adds, candidates that overlap exclude each other, and skip potentials join those that say
    the same. Weights are fitted by pseudo-likelihood: each label given the labels that it is joined with.
    """

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, 3), np.float32)
        self.chain = np.zeros((4, 3, 3), np.float32)
        self.skip = np.diag(SKIP_PRIOR).astype(np.float32)
        self.span_weights = np.zeros(BUCKETS, np.float32)
        self.span_skip = 0.5
        self.cache: dict[str, np.ndarray] = {}
        self.likely: set[str] = set()
        self.unlikely: set[str] = set()

    def fit(self, texts: list[str], epochs: int = 6, seed: int = 7) -> "Field":
        """Train on texts labelled by the names that stand behind bylines and by the words these names are made of.

        Runs of at least two such words are names; single ones are left out, since they may be parts of names that
        were not recognised. Everything else is labelled other.
        """
        reads = [Read.of(t) for t in texts]
        self.fit_spans(reads)
        known = _lexicon(reads)
        rng = np.random.default_rng(seed)
        share = max(0.15, 20_000 / max(1, sum(len(r.words) for r in reads)))  # names whole, other words by chance
        rows = array("i")
        labels, left, right, far = [], [], [], []
        for read in reads:
            text, ws = read.text, read.words
            if not len(ws):
                continue
            gaps = [gap(text, a, b) for a, b in _neighbours(ws)]
            marks = [known.get(w.low, FIRST if w.shape == 3 else OTHER) for w in ws]
            run = [0] * len(ws)
            i = 0
            while i < len(ws):
                j = i
                while j < len(ws) and marks[j] and (j == i or gaps[j - 1] != BREAK):
                    j += 1
                real = sum(ws[k].shape != 3 for k in range(i, j))
                for k in range(i, j):
                    run[k] = 1 if j - i > 1 and real else 0 if ws[k].shape == 3 else -1
                i = max(j, i + 1)
            y = [m if r == 1 else OTHER for m, r in zip(marks, run)]
            for k in range(len(ws) - 1):  # an unknown word beside a single known one may belong to its name
                if gaps[k] != BREAK and -1 in (run[k], run[k + 1]):
                    for j in (k, k + 1):
                        if not marks[j] and ws[j].shape in (1, 2):
                            run[j] = -2
            seen: dict[str, int] = {}
            chance = rng.random(len(ws))
            for i, w in enumerate(ws):
                if run[i] >= 0 and (y[i] or chance[i] < share):
                    rows.extend(_bucket(f) for f in lexical(w.low) + contextual(text, ws, i, gaps))
                    labels.append(y[i])
                    left.append(gaps[i - 1] * 3 + y[i - 1] if i else BREAK * 3)
                    right.append(gaps[i] * 3 + y[i + 1] if i + 1 < len(ws) else BREAK * 3)
                    far.append(y[seen[w.low]] if w.low in seen and w.shape != 3 else -1)
                seen[w.low] = i
        if not rows:
            return self
        x, y = np.frombuffer(rows, np.int32).reshape(len(labels), -1), np.array(labels)
        left, right, far = np.array(left), np.array(right), np.array(far)
        grad2, chain2, skip2 = np.full_like(self.weights, 1e-2), np.full_like(self.chain, 1.0), np.full_like(self.skip, 1.0)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 512)):
                xb, yb = x[part], y[part]
                s = self.weights[xb].sum(1)
                s += self.chain[left[part] // 3, left[part] % 3]
                s += self.chain[right[part] // 3, :, right[part] % 3]
                f = far[part]
                s[f >= 0] += self.skip[f[f >= 0]]
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), yb] -= 1
                hit, inverse = np.unique(xb, return_inverse=True)
                gh = np.zeros((len(hit), 3), np.float32)
                np.add.at(gh, inverse.ravel(), np.repeat(p, xb.shape[1], axis=0))
                gh += 1e-3 * self.weights[hit]
                grad2[hit] += gh * gh
                self.weights[hit] -= 0.25 * gh / np.sqrt(grad2[hit])
                gc, gs = np.zeros_like(self.chain), np.zeros_like(self.skip)
                np.add.at(gc, (left[part] // 3, left[part] % 3), p)
                np.add.at(gc.transpose(0, 2, 1), (right[part] // 3, right[part] % 3), p)
                np.add.at(gs, f[f >= 0], p[f >= 0])
                chain2 += gc * gc
                skip2 += gs * gs
                self.chain -= 0.25 * gc / np.sqrt(chain2)
                self.skip -= 0.25 * gs / np.sqrt(skip2)
        self.skip = (self.skip + self.skip.T) / 2
        return self

    def fit_spans(self, reads: list[Read], epochs: int = 8) -> None:
        """Fit what the context of candidates adds, on the labels that the priors alone would give."""
        rows, prior, labels, twin = [], [], [], []
        for read in reads:
            text, found, on = read.text, read.found, set(read.taken)
            seen: dict[tuple[str, str], float] = {}
            for a, b, kind, score in found:
                y = (a, b, kind) in on
                rows.append([_bucket(f) for f in span_context(text, a, b, kind)])
                prior.append(score)
                labels.append(y)
                same = _same(text, a, b, kind)
                twin.append(seen.get(same, 0.0))
                seen[same] = 1.0 if y else -1.0
        if not rows:
            return
        x, prior, y, twin = np.array(rows), np.array(prior), np.array(labels, float), np.array(twin)
        grad2, skip2 = np.full(BUCKETS, 1.0, np.float32), 1.0
        for _ in range(epochs):
            for part in np.array_split(np.arange(len(y)), max(1, len(y) // 256)):
                z = prior[part] + self.span_weights[x[part]].sum(1) + self.span_skip * twin[part]
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
                hit, inverse = np.unique(x[part], return_inverse=True)
                gh = np.bincount(inverse.ravel(), np.repeat(g, x.shape[1]), len(hit)) + 1e-2 * self.span_weights[hit]
                grad2[hit] += gh * gh
                self.span_weights[hit] -= (0.1 * gh / np.sqrt(grad2[hit])).astype(np.float32)
                gs = float((g * twin[part]).sum())
                skip2 += gs * gs
                self.span_skip = max(0.0, self.span_skip - 0.1 * gs / skip2**0.5)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """The likeliest candidates together, by loopy message passing (max-product)."""
        found = sorted(fixed_forms(text))
        if not found:
            return []
        unary = np.array([s + self.span_weights[[_bucket(f) for f in span_context(text, a, b, k)]].sum() + 1e-3 * (b - a) for a, b, k, s in found])
        frm, to, twins = [], [], []
        last: dict[tuple[str, str], int] = {}
        open_: list[int] = []
        for j, (a, b, k, _) in enumerate(found):
            open_ = [i for i in open_ if found[i][1] > a]
            for i in open_:
                frm.append(i), to.append(j), twins.append(False)
            open_.append(j)
            same = _same(text, a, b, k)
            if same in last and last[same] not in open_[:-1]:
                frm.append(last[same]), to.append(j), twins.append(True)
            last[same] = j
        belief = unary
        if frm:
            f, t, w = np.r_[frm, to], np.r_[to, frm], np.r_[twins, twins]
            back = np.r_[np.arange(len(frm)) + len(frm), np.arange(len(frm))]
            messages = np.zeros(len(f))
            for _ in range(20):
                belief = unary + np.bincount(t, messages, len(unary))
                h = belief[f] - messages[back]
                agree = np.maximum(self.span_skip + h, 0.0) - np.maximum(h, self.span_skip)
                new = np.where(w, agree, -np.maximum(h, 0.0))
                change = np.abs(new - messages).max()
                messages = 0.7 * new + 0.3 * messages
                if change < 1e-3:
                    break
            belief = unary + np.bincount(t, messages, len(unary))
        return resolve([(a, b, k, float(s)) for (a, b, k, _), s in zip(found, belief)])

    def _form(self, low: str) -> np.ndarray:
        got = self.cache.get(low)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[low] = self.weights[[_bucket(f) for f in lexical(low)]].sum(0)
        return got

    def may_name(self, text: str, least: float = -2.0) -> bool:
        """Whether any word's form speaks for a name, or against it by no more than ``least``."""
        found = set(_WORD.findall(text)) - self.unlikely
        for w in found - self.likely:
            s = self._form(w.casefold())
            (self.likely if len(w) > 1 and max(s[1], s[2]) - s[0] > least else self.unlikely).add(w)
        if len(self.unlikely) > 500_000:
            self.unlikely.clear()
        return not found.isdisjoint(self.likely)

    def label(self, text: str, ws: Words, least: float = -2.0) -> list[int]:
        """The label of each word by loopy message passing.

        A word whose form alone speaks against a name by more than ``least`` is other and takes no part.
        """
        out = [OTHER] * len(ws)
        self.may_name(text, least)
        live = [i for i, (a, b) in enumerate(ws.spans) if text[a:b] in self.likely]
        if not live:
            return out
        nodes = set(live)
        for i in live:  # initials count beside such words only
            nodes.update(j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(ws) and ws[j].shape == 3)
        order = sorted(nodes)
        at = {i: k for k, i in enumerate(order)}
        around = sorted({j for i in order for j in (i - 1, i) if 0 <= j < len(ws) - 1})
        gaps = [BREAK] * len(ws)
        for j in around:
            gaps[j] = gap(text, ws[j], ws[j + 1])
        unary = np.array([self._form(ws[i].low) + self.weights[[_bucket(f) for f in contextual(text, ws, i, gaps)]].sum(0) for i in order], np.float64)
        a, b, tables = [], [], []
        seen: dict[str, int] = {}
        for k, i in enumerate(order):
            for j, table in ((i - 1, self.chain[gaps[i - 1] if i else BREAK].T), (i + 1, self.chain[gaps[i] if i + 1 < len(ws) else BREAK])):
                if j not in at:
                    unary[k] += table[:, OTHER]
            if i + 1 in at:
                a.append(k), b.append(at[i + 1]), tables.append(self.chain[gaps[i]])
            if ws[i].shape != 3:
                if ws[i].low in seen:
                    a.append(seen[ws[i].low]), b.append(k), tables.append(self.skip)
                seen[ws[i].low] = k
        belief = unary
        if a:
            a, b, t = np.array(a), np.array(b), np.array(tables, np.float64)
            frm, to, pot = np.r_[a, b], np.r_[b, a], np.concatenate([t, t.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
            messages = np.zeros((len(frm), 3))
            for _ in range(20):
                belief = unary.copy()
                np.add.at(belief, to, messages)
                inner = (belief[frm] - messages[back])[:, :, None] + pot
                top = inner.max(1)
                new = top + np.log(np.exp(inner - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                change = np.abs(new - messages).max()
                messages = 0.7 * new + 0.3 * messages
                if change < 1e-3:
                    break
            belief = unary.copy()
            np.add.at(belief, to, messages)
        for i, label in zip(order, belief.argmax(1).tolist()):
            out[i] = label
        return out


def resolve(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of overlapping candidates the likeliest, then the longest; none of negative log-odds. In order of place."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind, _ in sorted((f for f in found if f[3] > 0), key=lambda f: (-f[3], f[0] - f[1], f[0])):
        at = bisect_left(out, (a, b, kind))
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
            out.insert(at, (a, b, kind))
    return out


def names(text: str, ws: Words, labels: list[int]) -> list[tuple[int, int]]:
    """Spans of first name or initial with surnames, in either order."""
    out, i, n = [], 0, len(ws)
    while i < n:
        if labels[i] == OTHER:
            i += 1
            continue
        j, parts = i, [labels[i]]
        turned = False
        while j + 1 < n and labels[j + 1] != OTHER:
            g = gap(text, ws[j], ws[j + 1])
            if g == BREAK:
                break
            if g == COMMA:
                if turned or FIRST in parts or labels[j + 1] != FIRST:
                    break
                turned = True
            elif labels[j + 1] == FIRST and SURNAME in parts and not turned and FIRST in parts and ws[j + 1].shape != 3:
                break  # the next person
            elif turned and labels[j + 1] == SURNAME:
                break
            j += 1
            parts.append(labels[j])
        if FIRST in parts and SURNAME in parts:
            out.append((ws[i].start, ws[j].end))
        i = j + 1
    return out


def find(text: str, field: Field) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, in order and without overlap."""
    fixed = field.spans(text)
    if not field.may_name(text):
        return fixed
    ws = Words(text, [(a, b) for a, b, _ in fixed])
    labels = field.label(text, ws)
    return sorted(fixed + [(a, b, "name") for a, b in names(text, ws, labels)])


#: Texts that the field is fitted on at most, those of the smallest hash of doc_id, and the longest of them in characters.
TRAIN_TEXTS, TRAIN_CHARS = 4000, 20_000


def fit_field(documents: DataFrame, texts: int = TRAIN_TEXTS) -> Field:
    """The field fitted on a bounded sample of documents that the bylines label; see TRAIN_TEXTS."""
    sample = documents.where(F.col("text").isNotNull() & F.length("text").between(1, TRAIN_CHARS)).select("doc_id", "text")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(texts).collect()
    return Field().fit([r.text for r in rows])


def _with_field(documents: DataFrame, field: Field | None):
    field = field or fit_field(documents)
    hit = np.flatnonzero(np.abs(field.weights).max(1) > 0)
    spans = np.flatnonzero(field.span_weights)
    return documents.sparkSession.sparkContext.broadcast((hit, field.weights[hit], field.chain, field.skip, spans, field.span_weights[spans], field.span_skip))


def _unpack(parts: tuple) -> Field:
    field = Field()
    field.weights[parts[0]] = parts[1]
    field.chain, field.skip = parts[2], parts[3]
    field.span_weights[parts[4]] = parts[5]
    field.span_skip = parts[6]
    return field


def find_pii(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, pii_kind, pii_text, each once per document: what stands in the whole texts.

    The field labels words and candidates of each text, in one pass without a shuffle.
    Null and empty texts give no rows. Documents keep their id as it is, null too.
    """
    model = _with_field(documents, field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpack(model.value)
        for batch in batches:
            docs, kinds, texts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, found in dict.fromkeys((kind, text[a:b]) for a, b, kind in find(text, own)):
                    docs.append(doc), kinds.append(kind), texts.append(found)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "pii_kind": pa.array(kinds, pa.string()), "pii_text": pa.array(texts, pa.string())})

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(scan, "doc_id long, pii_kind string, pii_text string").distinct()


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, text: with [NAME], [EMAIL], [PHONE], [NATIONAL_ID] and [ADDRESS] in place of what is found, else unchanged.

    One row per row of documents; null and empty texts stay as they are.
    """
    model = _with_field(documents, field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpack(model.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if text:
                    pieces, at = [], 0
                    for a, b, kind in find(text, own):
                        pieces += [text[at:a], f"[{kind.upper()}]"]
                        at = b
                    text = "".join([*pieces, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, text string")
