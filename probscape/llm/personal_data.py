"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages, by_id, text_rows, texts

#: The kinds of spans, in the order of all results.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRACE = re.compile(r"[0-9@=:]|\[at\]|\(at\)| at ")

# Looser patterns, whose matches count only if the classifier takes them.
_LOOSE = (
    (EMAIL, re.compile(r"(?<![\w.+-])[+.-]*+([A-Za-z][\w.+-]*+ ?(?:\[at\]|\(at\)|@| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,12}\b)")),
    (IP, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (CARD, re.compile(r"(?<![0-9])(?:3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[2-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3})(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])")),
    (SECRET, re.compile(r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|pwd)\b)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{8,}+)")),
)

#: Gazetteers (fixed values): endings of host names, and words that stand before data of a kind, or of none.
ENDINGS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at pl pt se no dk fi ie eu ru cn jp in br mx ca au nz dev app me tv example test".split())
CUES = (
    frozenset("mail email e-mail contact write correo courriel kontakt".split()), frozenset("ip host server address login adresse".split()),
    frozenset("card visa mastercard credit debit tarjeta carte karte".split()), frozenset("phone tel call mobile fax telefon telefono téléphone".split()),
    frozenset("token key secret password passwd pwd bearer auth".split()),
)
NO_CUES = frozenset("version release isbn issn order page chapter section article figure table model part serial".split())

_WORD = re.compile(r"[^\W\d_][\w-]*")
LABELERS = 5
BITS = 6
#: Codes of a candidate: kind, a vote of each labeler, feature bits. This bounds the counts that EM sees.
CODES = len(KINDS) * 3**LABELERS * 2**BITS
NO, YES, ABSTAIN = range(3)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ signs, so that long runs are read once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        match = _DOMAIN.match(text, at) if at > done and text[at - 1] in _LOCAL else None
        if match:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the four base kinds, by kind and start."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((PHONE, m.start(), m.end()))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates; none overlaps a base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for kind, pattern in _LOOSE:
        i = 0
        for m in pattern.finditer(text):
            a, b = m.span(pattern.groups)
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if (i == len(taken) or taken[i][0] >= b) and (kind != CARD or luhn(_digits(m[0]))):
                out.append((kind, a, b))
    return out


def code(text: str, kind: int, start: int, end: int, is_base: bool) -> int:
    """The labelers' votes and the classifier's features of a span, as one number."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[start - 1: start], text[end: end + 1]
    words = {w.lower() for w in _WORD.findall(text[max(0, start - 40): start])[-4:]}
    shape = {
        EMAIL: lambda: span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in ENDINGS,
        IP: lambda: ":" in span or not any(len(p) > 1 and p[0] == "0" for p in span.split(".")),
        CARD: lambda: luhn(digits),
        PHONE: lambda: len(re.findall("[0-9]+", span)) <= 6,
        SECRET: lambda: bool(digits) and len(set(span)) >= 6,
    }[kind]()
    size = {
        EMAIL: lambda: 6 <= len(span) <= 80, IP: lambda: 7 <= len(span) <= 45, CARD: lambda: span[0] in "3456",
        PHONE: lambda: 9 <= len(digits) <= 14, SECRET: lambda: len(span) >= 12,
    }[kind]()
    free = not (before.isalnum() or after.isalnum() or before in ("_", "#") and before or after == "_")
    votes = (
        YES if is_base else ABSTAIN,
        YES if shape else NO,
        YES if words & CUES[kind] else NO if words & NO_CUES else ABSTAIN,
        YES if free else NO,
        YES if size else NO,
    )
    bits = (any(c in " .-()@" for c in span), any(c.isalpha() for c in span), not before or before.isspace(),
            not after or not after.isalnum(), before in ('"', "'", "(", "[") and bool(before), len(span) >= 16)
    out = kind
    for vote in votes:
        out = 3 * out + vote
    for bit in bits:
        out = 2 * out + bit
    return out


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (rows of labelers) and feature bits of codes."""
    bits = (codes[:, None] >> np.arange(BITS - 1, -1, -1)) & 1
    rest = codes >> BITS
    votes = (rest[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1)) % 3
    return rest // 3**LABELERS, votes, bits


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The chance that each vote pattern is personal data, by expectation-maximisation.

    Each labeler has its own chances of voting no, yes or not at all for true and for false spans; votes
    are independent given the truth. Starts from the majority of votes.
    """
    chance = (1 + (votes == YES).sum(axis=1)) / (2 + (votes != ABSTAIN).sum(axis=1))
    for _ in range(rounds):
        good, poor = chance * count, (1 - chance) * count
        score = np.log((good.sum() + 1) / (poor.sum() + 1)) * np.ones(len(count))
        for j in range(votes.shape[1]):
            yes, no = (np.bincount(votes[:, j], w, 3) + 1 for w in (good, poor))
            score += np.log(yes / yes.sum() / (no / no.sum()))[votes[:, j]]
        new = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        if np.abs(new - chance).max() < 1e-9:
            break
        chance = new
    return chance


@dataclass
class SpanClassifier:
    """Logistic scores of kinds and their feature bits."""

    weights: np.ndarray

    def chance(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(codes) @ self.weights, -40, 40)))


def design(codes: np.ndarray) -> np.ndarray:
    """A column for each kind and one for each of its feature bits."""
    kinds, _, bits = decode(codes)
    own = np.concatenate((np.ones((len(codes), 1)), bits), axis=1)
    out = np.zeros((len(codes), len(KINDS), BITS + 1))
    out[np.arange(len(codes)), kinds] = own
    return out.reshape(len(codes), -1)


def fit(codes: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> SpanClassifier:
    """Trains the span classifier on EM's chances, kind by kind; at most ``CODES`` rows."""
    weights = np.zeros(len(KINDS) * (BITS + 1))
    if not len(codes):
        return SpanClassifier(weights)
    kinds, votes, _ = decode(codes)
    target = np.zeros(len(codes))
    for kind in np.unique(kinds):
        own = kinds == kind
        target[own] = reliabilities(votes[own], count[own].astype(float))
    rows = design(codes)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -40, 40)))
        slope = rows.T @ (count * (p - target)) + ridge * weights
        bend = (rows * (count * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return SpanClassifier(weights)


_CANDIDATES = "doc_id long, kind array<int>, start array<long>, stop array<long>, base array<boolean>, code array<int>"


def candidates(docs: DataFrame) -> DataFrame:
    """Each document's candidate spans with their codes; one pass over the texts."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
        for batch in text_rows(batches):
            columns: list[list] = [[], [], [], [], []]
            for raw in texts(batch):
                rows = text_spans(raw.decode())
                for i, column in enumerate(columns):
                    column.append([r[i] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))], ["doc_id", "kind", "start", "stop", "base", "code"])

    return by_id(docs).mapInArrow(made, _CANDIDATES)


def chances(found: DataFrame) -> dict[int, float]:
    """The classifier's chance of every code that occurs, trained on the counts of codes (``CODES`` at most)."""
    counts = found.select(F.explode("code").alias("code")).groupBy("code").count().orderBy("code").collect()
    codes = np.array([r[0] for r in counts], np.int64)
    model = fit(codes, np.array([r[1] for r in counts], float))
    return {int(c): float(p) for c, p in zip(codes, model.chance(codes))} if len(codes) else {}


def text_spans(text: str) -> list[tuple[int, int, int, bool, int]]:
    """``kind, start, end, base, code`` of the candidates of a text, by kind and start."""
    if not _TRACE.search(text):
        return []
    base = base_spans(text)
    rows = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in loose_spans(text, base)]
    return [(*r, code(text, *r)) for r in sorted(rows)]


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: of every row of ``docs`` the spans of personal data.

    A span has ``kind, start, stop`` (code points, end exclusive), ``base`` and ``chance``; spans are in
    the order of ``KINDS``, then by start. Base spans are those of the fixed patterns. Further candidates
    of looser patterns count where the final classifier gives them a chance of a half or more: labelers
    (pattern, shape, gazetteer, context, size) vote on every candidate of all documents, EM estimates
    their reliabilities from the counts of vote patterns, and the classifier is trained on its chances.

    Null and empty texts have no spans. Repeated rows and null ids are handled like any other; other
    columns are not read; an empty table gives an empty result.
    """
    found = Stages(docs.sparkSession, "personal-data").keep(candidates(docs))
    chance = chances(found)
    if not chance:
        return found.select("doc_id", F.expr("cast(array() AS array<struct<kind:string, start:bigint, stop:bigint, base:boolean, chance:double>>)").alias("spans"))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("chance", pa.float64())]))
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": a, "stop": b, "base": own, "chance": chance[c]} for k, a, b, own, c in zip(*row) if own or chance[c] >= 0.5]
                for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return found.mapInArrow(judged, "doc_id long, spans array<struct<kind:string, start:bigint, stop:bigint, base:boolean, chance:double>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of the result of ``personal_data``, and beside the
    counts of base spans ``n_secret``, ``n_added`` (all spans that are no base spans) and ``found`` (any span)."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS[:4]]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == KINDS[SECRET])).cast("long")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        secrets.alias("n_secret"), added.alias("n_added"), (F.size("spans") > 0).alias("found"))


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; overlapping spans become one mark."""
    chance = chances(Stages(docs.sparkSession, "personal-data").keep(candidates(docs)))

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            parts, at = [], 0
            spans = [s for s in text_spans(text or "") if s[3] or chance[s[4]] >= 0.5]
            for kind, start, stop, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                if start >= at:
                    parts += [text[at:start], mark.format(KINDS[kind])]
                at = max(at, stop)
            out.append(None if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return docs.withColumn("text", redacted(F.col("text").cast("string")))
