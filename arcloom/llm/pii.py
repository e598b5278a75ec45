"""Personal data: spans that patterns define, and more that weak labelers agree on.

The base patterns stand as they are. Around them a wider net proposes candidates:
written-out addresses, numbers in national or broken form, long hexadecimal keys.
Labelers of four sorts (patterns, checks, word lists, context) vote on each
candidate, base spans included; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind, without any labels;
and a logistic classifier of votes and span features, trained on the resulting
probabilities, decides which candidates become spans. Votes and features take few
values, so what travels to the driver is one row per combination, not per span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.session import scratch_path

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "check", "list", "context", "edges", "digits")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Base patterns. (Fixed by contract.) Those with leading lookbehind and possessive
# runs match what the plain patterns match, in time linear in the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The wider net.
SPELT_AT = re.compile(r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:[\[(]\x20?(?:dot|DOT)\x20?[\])]|\.)\x20?[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9\x20().-]{5,24}[0-9](?![0-9A-Za-z])")
KEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")

# Word lists of the labelers. (Choice.)
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es it uk eu ch at nl be pl us ca".split())
HINTS = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "handy"),
    "secret": ("key", "token", "secret", "password", "api", "sha"),
}
AGAINST = ("version", "v.", "license", "chapter", "page", "figure", "isbn")
CONTEXT = 30


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: every start before an ``@`` leads to that ``@``, so its run decides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start; leftmost and non-overlapping within a kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _wider(text: str) -> Iterator[tuple[str, int, int]]:
    for m in SPELT_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        domain = SPELT_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            yield "email", start, domain.end()
    for m in NUMBERS.finditer(text):
        s = m.group()
        n = len(_digits(s))
        if s.count(".") == 3 and s.replace(".", "").isdigit():
            yield "ip", m.start(), m.end()
        elif 13 <= n <= 19:
            yield "card", m.start(), m.end()
        elif 9 <= n <= 12:
            yield "phone", m.start(), m.end()
    for m in KEY.finditer(text):
        if not m.group().isdigit():
            yield "secret", m.start(), m.end()


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One of ``+ - 0`` for each of ``LABELERS``."""
    s = text[start:end]
    digits = _digits(s)
    before = text[max(0, start - CONTEXT) : start].lower()
    sign = lambda good, bad=False: "+" if good else "-" if bad else "0"
    if kind == "email":
        listed = s.rsplit(".", 1)[-1].strip(" )]").lower() in TOP_DOMAINS
        check = sign(8 <= len(s) <= 80, True)
    elif kind == "ip":
        parts = s.strip("()").split(".")
        check = sign(all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), True)
        listed = not s.startswith(("0.", "127."))
    elif kind == "card":
        check, listed = sign(luhn(digits), True), digits[:1] in "3456"
    elif kind == "phone":
        groups = [g for g in re.split("[^0-9]+", s) if g]
        check = sign(9 <= len(digits) <= 15 and 2 <= len(groups) <= 5, len(groups) == 1)
        listed = s.startswith("+") or digits.startswith("00") or "(" in s
    else:
        check, listed = sign(len(s) in (32, 40, 64), True), '"' in text[max(0, start - 1) : end + 1]
    context = sign(any(h in before for h in HINTS[kind]), any(h in before for h in AGAINST))
    left, right = text[start - 1 : start] if start else " ", text[end : end + 1] or " "
    edges = sign(left in " \t\n\"'(<:=|," and right in " \t\n\"').,;:!?>|*$&%#", left.isalnum() or right.isalnum())
    varied = sign(len(set(digits)) >= 4, len(digits) > 3 and len(set(digits)) <= 2)
    return sign(base) + check + sign(listed) + context + edges + varied


def _features(text: str, start: int, end: int) -> str:
    """Length, share of digits and number of marks, in few steps each."""
    s = text[start:end]
    n = len(s)
    marks = sum(not c.isalnum() for c in s)
    return f"{min(n // 8, 7)}{sum(c.isdigit() for c in s) * 3 // n}{min(marks, 5)}"


CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,pattern:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``, stored: base spans and candidates of each row of ``docs (doc_id, text)``.

    Candidates that touch a base span, or an earlier candidate, are left out. Places
    are code points, ends exclusive. A null text is empty and has none.
    """

    @F.pandas_udf(CANDIDATES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_find(t) for t in batch], dtype=object)

    path = scratch_path(docs.sparkSession, "candidates")
    docs.select("doc_id", find(F.coalesce("text", F.lit(""))).alias("found")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _find(text: str) -> list[dict]:
    base = base_spans(text)
    more, taken = [], sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    # Base spans of several kinds may overlap: how far those reach that begin up to each.
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    last = -1
    for kind, a, b in sorted(_wider(text), key=lambda x: (x[1], -x[2])):
        i = int(np.searchsorted(starts, b)) if starts else 0
        if a >= last and not (i and reach[i - 1] > a):
            more.append((kind, a, b))
            last = b
    return [
        {"kind": k, "start": a, "end": b, "base": is_base,
         "pattern": f"{k}|{_votes(text, k, a, b, is_base)}|{_features(text, a, b)}"}
        for spans, is_base in ((base, True), (more, False)) for k, a, b in spans
    ]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation of one kind: probability of each vote row, P(vote | class), prior.

    ``votes`` (rows x labelers, values 0 to 2 for ``- 0 +``), ``counts`` per row. Starts
    from the share of positive votes; one is added to every count, so that nothing
    that was not seen is impossible.
    """
    up, down = (votes == 2).sum(1), (votes == 0).sum(1)
    p = np.clip((up + 0.5) / (up + down + 1.0), 0.05, 0.95)
    table = np.zeros((2, votes.shape[1], 3))
    prior = 0.5
    for _ in range(rounds):
        prior = float((p * counts).sum() + 1) / float(counts.sum() + 2)
        for c, share in enumerate((1 - p, p)):
            for j in range(votes.shape[1]):
                seen = np.bincount(votes[:, j], weights=share * counts, minlength=3) + 1.0
                table[c, j] = seen / seen.sum()
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            odds += np.log(table[1, j, votes[:, j]]) - np.log(table[0, j, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, table, prior


def _design(patterns: list[str]) -> np.ndarray:
    """Kind, votes and features as indicator columns."""
    rows = np.zeros((len(patterns), 1 + len(KINDS) + 3 * len(LABELERS) + 3 * 10))
    for i, pattern in enumerate(patterns):
        kind, votes, steps = pattern.split("|")
        rows[i, 0] = 1
        rows[i, 1 + KINDS.index(kind)] = 1
        for j, v in enumerate(votes):
            rows[i, 1 + len(KINDS) + 3 * j + "-0+".index(v)] = 1
        for j, s in enumerate(steps):
            rows[i, 1 + len(KINDS) + 3 * len(LABELERS) + 10 * j + int(s)] = 1
    return rows


def train(found: DataFrame, rounds: int = 30) -> dict[str, float]:
    """The classifier's probability for each pattern that occurs, from all candidates.

    ``found`` is made by ``candidates``. At most kinds x 3 ** labelers x feature steps
    patterns exist, however many documents there are.
    """
    seen = (
        found.select(F.explode("found.pattern").alias("pattern"))
        .groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")
    )
    if seen.empty:
        return {}
    patterns, counts = seen["pattern"].tolist(), seen["n"].to_numpy(np.float64)
    kinds = np.array([p.split("|")[0] for p in patterns])
    votes = np.array([["-0+".index(v) for v in p.split("|")[1]] for p in patterns])
    soft = np.zeros(len(patterns))
    for kind in np.unique(kinds):
        mine = kinds == kind
        soft[mine] = reliabilities(votes[mine], counts[mine])[0]
    x = _design(patterns)
    weight = counts / counts.sum()
    w = np.zeros(x.shape[1])
    # Newton steps with a small ridge; the problem is convex and small.
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - soft)) + 1e-4 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(patterns, p.tolist()))


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, spans)`` for each row: ``array<struct<kind, start, end, base>>``.

    Base spans all stay; a candidate is added if the classifier gives it at least
    ``threshold``. By kind in the order of ``KINDS``, then by start.
    """
    found = candidates(docs)
    accepted = [p for p, chance in train(found).items() if chance >= threshold]
    keep = F.filter("found", lambda c: c["base"] | c["pattern"].isin(accepted))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        keep,
        lambda c: F.struct(
            F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"),
            c["kind"].alias("kind"), c["base"].alias("base"),
        ),
    )
    return found.select(
        "doc_id",
        F.transform(
            F.array_sort(keyed),
            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")),
        ).alias("spans"),
    )
