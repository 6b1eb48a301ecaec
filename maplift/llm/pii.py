"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for other spellings.

Patterns find e-mail addresses, IP addresses, card and phone numbers in their usual form.  The CRF
labels the words of each line (O, email, ip, card, phone); its features are the shapes of a word and of its
two neighbours (digits, letters and marks, runs shortened), its number of digits and its first and last
character class.  It is trained by gradient ascent on the small table ``LABELLED`` and decoded by Viterbi in
numpy batches of lines.  It finds spellings that the patterns leave out, such as ``(555) 010-2345``,
``ann (at) example.org`` or ``10[.]0[.]0[.]7``; its spans are added where no pattern matched.

A word of letters and common punctuation (no dot before a letter) has one and the same shape, and a line of such words alone is
labelled O throughout, so only lines with other words are decoded.

Defined results: null and empty texts have no spans; rows with a null or repeated doc_id are searched like any
other; extra columns are ignored.  Offsets are code points, the end is exclusive.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maplift.llm.common import prepare, slices, text_bytes, texts_of
from maplift.llm.wordhash import words_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

#: The labelled table: personal data in {kind:...}, all else is O.
LABELLED = """
please call {phone:(555) 010-2345} before noon
my number is {phone:(212) 010-9876} and I wait
reach the desk at {phone:555-010-7788} or write
fax {phone:(555) 010-4471}, office closed
she left {phone:555 010 3321} with the clerk
call {phone:(415) 010 6612} or {phone:(415) 010-6613} today
{phone:(555) 010-1199} is the new line
phone {phone:303-010-4488}.
the hotline {phone:800-010-2200} is free
write to {email:ann (at) example.org} for details
mail {email:bob.lee [at] example.com} or come by
contact {email:c_day(at)example.net} please
ask {email:dora[at]example.org}, she knows
send it to {email:eve@mail} soon
{email:finn (at) example.net}, {email:gus (at) mail.example.com} and others
so {email:hal [at] example.org}. Then
end.Start of a sentence without a blank, e.g. this one
the site www.example.org is open
the file notes.txt or a.b here
the host {ip:10[.]0[.]0[.]7} was down
blocked {ip:192[.]168[.]1[.]44} again
from {ip:172(.)16(.)4(.)9} to the gate
saw {ip:203[.]0[.]113[.]5}, twice
card {card:4000_1234_5678_9010} was charged
pay with {card:5100.2222.3333.4444} now
in 2023 there were 45 cases and 3 more
the value 3.14 is near 22/7 of it
pages 12-14 and (see note 3) for more
it costs 1,200 or 50% of that
version 2.10.3 came out on 2021-05-04
at 12:30 the train left (on time)
token = "a94f00b1c2d3e4f5a6b7c8d9"
password=0f3e2d1c4b5a in the file
order 4716253849501726 was sent in 3 days
call me at ann@example.org or +1 (555) 010-2345 now
address 10.0.0.7 is local and 8080 is open
+44 20 7946 0018 rings
the (first) and [second] of them
a [1] b [2] (3) c (4.5) d
score 10-2 after 90 minutes
room 101-104 and 2-3 others (5)
numbers 555 and 010 alone mean nothing
1 2 3 4 5 6 7 8 9 10
see (at) the end of [it] now
he said (at 5) they came
x=1 y=22 z=333 total 4444
http://example.org/a/1 was read 100 times
<b>bold</b> #4 @ 5 & 6
4000 1234 5678 9010 paid
id 12345-678 and 9876543210 here
serial 123-45 or 1234-56 or 12-345678
a_b c_d [x] (y) {z} 1_000
isbn 978-3-16-148410-0 printed
from 1990-1995 and 2001-2010 on
(1999) (2001) 300-400
"""

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot start within a run of digits unless at its start, hence the look-behind (no rescans of long runs)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as in KINDS, then start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        m = _EMAIL_END.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ------------------------------------------------------------------ word shapes
def _marks() -> np.ndarray:
    b = np.arange(256)
    letter = (b >= 0x41) & (b <= 0x5A) | (b >= 0x61) & (b <= 0x7A) | (b >= 0x80)
    return ~(letter | np.isin(b, list(b".,;:!?'\"|-%$&*#")))


_UNUSUAL = _marks()
_LETTER = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_INNER_DOT = re.compile(rb"\.[0-9A-Za-z\x80-\xff]")
PLAIN = ("shape=w",)
EDGE = ("shape=-",)


def shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), s)


def features(word: str | None) -> tuple[str, ...]:
    """Features of a word itself; its neighbours take them as well, under other names."""
    if word is None:
        return EDGE
    raw = word.encode()
    if not any(_UNUSUAL[b] for b in raw) and not _INNER_DOT.search(raw):
        return PLAIN
    core = word.rstrip(".,;:!?'\"|")
    digits = sum(c in "0123456789" for c in word)
    return (f"shape={shape(core)}", f"runs={re.sub('9+', '9', shape(core))}", f"digits={min(digits, 20)}", f"first={shape(core[:1])}", f"last={shape(core[-1:])}",
            "at" if "@" in core else "no at")


def labelled_rows() -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the labelled table."""
    rows = []
    for line in LABELLED.strip().split("\n"):
        words, labels = [], []
        for m in re.finditer(r"\{(" + "|".join(KINDS) + r"):([^}]*)\}([.,;:]?)|(\S+)", line):
            part = (m[2] + m[3]).split() if m[1] else [m[4]]
            words += part
            labels += [m[1] or "O"] * len(part)
        rows.append((words, labels))
    return rows


# ------------------------------------------------------------------ the model
@dataclass
class Crf:
    """Weights by feature name and label, for the word itself and as a neighbour, and between labels."""
    weight: dict[str, np.ndarray]
    step: np.ndarray
    first: np.ndarray

    def scores(self, word: str | None) -> np.ndarray:
        """3 x labels: what the word adds for itself, for the word after it and for the word before it."""
        none = np.zeros(len(LABELS))
        return np.array([sum((self.weight.get(f"{side}{f}", none) for f in features(word)), none) for side in ("", "prev ", "next ")])

    def viterbi(self, emission: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best labels of a batch: emission lines x words x labels, size: words of each line."""
        n, t, k = emission.shape
        best, back = self.first + emission[:, 0], np.zeros((n, t, k), np.int8)
        for i in range(1, t):
            both = best[:, :, None] + self.step
            prev = both.argmax(axis=1)
            new = np.take_along_axis(both, prev[:, None], 1)[:, 0] + emission[:, i]
            live = (i < size)[:, None]
            back[:, i] = np.where(live, prev, np.arange(k))
            best = np.where(live, new, best)
        out = np.zeros((n, t), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = np.take_along_axis(back[:, i], out[:, i][:, None].astype(np.int64), 1)[:, 0]
        return out


def _design(rows: list[tuple[list[str], list[str]]]) -> tuple[dict[str, int], list[list[list[int]]]]:
    names: dict[str, int] = {}
    designs = []
    for words, _ in rows:
        own = [features(w) for w in words]
        around = [EDGE, *own, EDGE]
        designs.append([[names.setdefault(n, len(names)) for n in
                         [*own[i], *(f"prev {f}" for f in around[i]), *(f"next {f}" for f in around[i + 2])]]
                        for i in range(len(words))])
    return names, designs


@lru_cache(maxsize=1)
def trained_crf(steps: int = 300, rate: float = 0.1, l2: float = 0.02) -> Crf:
    """Maximum likelihood on the labelled table (Adam, forward-backward over all rows at once)."""
    rows = labelled_rows()
    names, designs = _design(rows)
    k, n, t = len(LABELS), len(rows), max(len(w) for w, _ in rows)
    x = np.zeros((n, t, len(names)))
    y, size = np.zeros((n, t), np.int64), np.array([len(w) for w, _ in rows])
    for r, (design, (_, labels)) in enumerate(zip(designs, rows)):
        for i, (f, lab) in enumerate(zip(design, labels)):
            x[r, i, f] = 1
            y[r, i] = LABELS.index(lab)
    live = (np.arange(t) < size[:, None])[:, :, None]
    gold = np.eye(k)[y] * live
    gold_step = np.einsum("nia,nib->ab", gold[:, :-1], gold[:, 1:])
    parts = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for s in range(1, steps + 1):
        w, step, first = parts
        e = x @ w
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = first + e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(live[:, i], lse(alpha[:, i - 1][:, :, None] + step, 1) + e[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(live[:, i + 1], lse(step + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * live
        pair = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, :, None]
        grads = [np.einsum("nif,nik->fk", x, p - gold) / n + l2 * w / 10, (pair.sum((0, 1)) - gold_step) / n + l2 * step / 10,
                 (p[:, 0] - gold[:, 0]).mean(0)]
        for part, g, m in zip(parts, grads, moments):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            part -= rate * (m[0] / (1 - 0.9 ** s)) / (np.sqrt(m[1] / (1 - 0.999 ** s)) + 1e-8)
    w, step, first = parts
    return Crf({name: w[i] for name, i in names.items()}, step, first)


class Tagger:
    """Labels the words of a slice of texts."""
    def __init__(self, model: Crf) -> None:
        self.model = model
        self.plain, self.edge = model.scores("w"), model.scores(None)
        self.known: dict[bytes, np.ndarray] = {}

    def _scores(self, word: bytes) -> np.ndarray:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[word] = self.model.scores(word.decode("utf-8", "replace"))
        return got

    def spans(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, label, start byte, end byte) of the runs of words with one label other than O."""
        w = words_of(buf, off, "space")
        n = len(w.start)
        if not n:
            return []
        marked = _UNUSUAL[buf]
        marked[:-1] |= (buf[:-1] == 0x2E) & _LETTER[buf[1:]]  # a dot within a word
        unusual = np.append(0, np.cumsum(marked))
        odd = unusual[w.end] > unusual[w.start]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
        line = np.cumsum(buf == 10)[w.start]
        cut = np.append(True, (np.diff(line) > 0) | (np.diff(doc) > 0))
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, n))
        asked = np.flatnonzero(np.add.reduceat(odd, first) > 0)
        raw, out = buf.tobytes(), []
        order = asked[np.argsort(size[asked], kind="stable")]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and size[order[hi]] * (hi + 1 - lo) <= 100_000:
                hi += 1
            group = order[lo:hi]
            lo = hi
            t = int(size[group].max())
            own = np.tile(self.plain, (len(group), t + 2, 1, 1))  # with an edge before and after each line
            own[:, 0] = self.edge
            for r, g in enumerate(group.tolist()):
                own[r, size[g] + 1] = self.edge
                for i in np.flatnonzero(odd[first[g]: first[g] + size[g]]).tolist():
                    at = first[g] + i
                    own[r, i + 1] = self._scores(raw[w.start[at]: w.end[at]])
            labels = self.model.viterbi(own[:, 1:-1, 0] + own[:, :-2, 1] + own[:, 2:, 2], size[group])
            for r in np.flatnonzero((labels != 0).any(axis=1)).tolist():
                g = int(group[r])
                lab = labels[r, : size[g]]
                edges = np.flatnonzero(np.append(True, lab[1:] != lab[:-1]))
                for a, b in zip(edges, np.append(edges[1:], len(lab))):
                    if lab[a]:
                        out.append((int(doc[first[g]]), int(lab[a]), int(w.start[first[g] + a]), int(w.end[first[g] + b - 1])))
        return sorted(out)


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added that touch none of them, by kind as in KINDS, then start."""
    more = [s for s in added if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
    return sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_in(col: pa.Array, tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text of a column without nulls."""
    buf, off = text_bytes(col)
    texts = col.to_pylist()
    added: dict[int, list] = {}
    for doc, label, start, end in tagger.spans(buf, off):
        raw = buf[off[doc]: off[doc + 1]].tobytes()
        start, end = start - int(off[doc]), end - int(off[doc])
        word = raw[start:end].decode()
        cut = word.rstrip(".,;:!?'\"|")
        head = len(cut) - len(cut.lstrip("'\"|"))
        at = len(raw[:start].decode())
        if len(cut) > head:
            added.setdefault(doc, []).append((LABELS[label], at + head, at + len(cut)))
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, all_spans(base, added.get(i, []))))
    return out


def personal_data(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, base and spans (arrays of kind, start, end), spans holding base and what the CRF adds."""
    prepare(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(trained_crf())
    typ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(known.value)
        for batch in batches:
            for b in slices(batch):
                found = find_in(b.column(1), tagger)
                cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], typ) for i in (0, 1)]
                yield pa.record_batch([b.column(0), *cols], names=["doc_id", "base", "spans"])
    span = "array<struct<kind:string,start:long,end:long>>"
    return texts_of(documents).mapInArrow(run, f"doc_id long, base {span}, spans {span}")
