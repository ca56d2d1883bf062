"""Secret scans by grammar inference.

Three fixed patterns give the base spans. Of their values in all documents a bounded sample makes the
labelled credentials. A string is read as symbols: each run of letters and digits by its character set (hex,
lower case with digits, mixed case and so on), one symbol per character, marks as they are; so strings of one
format share a path and its length. For each kind of base span the strings build a prefix tree with counts,
whose states are merged (ALERGIA: Hoeffding-compatible outgoing and ending frequencies, recursively) into a
probabilistic automaton; another automaton is inferred from ordinary long tokens. Every long token of every
text is then scored in full, and so are the long pieces between its separators: one that a credential
automaton finds about as likely, ending included, as the credentials it was inferred from, and likelier than
the ordinary one does, adds a span of kind `format`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.tables import table

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: Shortest candidate, and the pieces of one that are scored when the whole is not a credential, coarse ones first.
LEAST_LENGTH, PIECES = 16, (re.compile(r"[^.=]+"), re.compile(r"[^/.=_+-]+"))
#: The bounded training sample: distinct strings of each automaton. Longer strings are no examples.
MAX_STRINGS, MAX_LENGTH = 600, 512
#: Parts in which the strings of a kind are thinned out first.
SALTS = 64
#: Log likelihood by which a string must be likelier as a credential than as an ordinary token. Unlabelled credentials
#: are among the ordinary tokens too, so it is that of the whole string: how much more usual the format is with labels.
LEAST_MARGIN = 1.0
#: Log likelihood per character by which a string may be less likely than nearly all labelled credentials are.
SLACK = 0.1
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, leftmost and non-overlapping per kind, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


RUN = re.compile(r"[A-Za-z0-9]+|.", re.DOTALL)
#: Symbol of a run by its character set; the first that fits.
SETS = tuple((symbol, re.compile(chars + "+")) for symbol, chars in (("d", "[0-9]"), ("l", "[a-z]"), ("u", "[A-Z]"), ("x", "[0-9a-f]"), ("X", "[0-9A-F]"), ("m", "[0-9a-z]"), ("M", "[0-9A-Z]"), ("w", "[A-Za-z]")))


def symbols(token: str) -> str:
    """A token with each run of letters and digits as its character set's symbol, once per character; marks stay."""
    return "".join(next((k for k, chars in SETS if chars.fullmatch(r)), "b") * len(r) if r.isalnum() else r for r in RUN.findall(token))


#: Symbols there are: those of runs, the marks a candidate may have, and the end.
N_SYMBOLS = len(SETS) + 1 + len("+/_.=-") + 1


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, strings: list[str], alpha: float | None = None):
        # the more strings, the fewer states may be merged by chance
        alpha = min(0.5, 8 / max(len(strings), 1)) if alpha is None else alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                at = self.next[at][c]
            self.end[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[p] / n - self.end[q] / m) > limit:
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p].get(c, 0) / n - self.count[q].get(c, 0) / m) > limit:
                    return False
                if c in self.next[p] and c in self.next[q] and self.next[p][c] != self.next[q][c]:
                    stack.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree under q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.end[p] += self.end[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c not in self.next[p]:
                    self.next[p][c] = self.next[q][c]
                elif self.next[p][c] != self.next[q][c]:
                    stack.append((self.next[p][c], self.next[q][c]))

    def _merge_states(self) -> None:
        red = [0]
        while True:
            blue = next(((r, c, q) for r in red for c, q in sorted(self.next[r].items()) if q not in red), None)
            if blue is None:
                break
            r, c, q = blue
            for p in red:
                if self._compatible(p, q):
                    self.next[r][c] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
        self.states = len(red)

    def _log(self, n: int, total: int) -> float:
        """Smoothed log probability: over all symbols and the end it sums to one."""
        return math.log((n + 0.1) / (total + 0.1 * N_SYMBOLS))

    def log_likelihood(self, string: str) -> float:
        """Log likelihood per symbol, the end included; after an unknown transition all symbols are alike."""
        at, total = 0, 0.0
        for i, c in enumerate(string):
            total += self._log(self.count[at].get(c, 0), self._total(at))
            if c not in self.next[at]:
                return (total - (len(string) - i) * math.log(N_SYMBOLS)) / (len(string) + 1)
            at = self.next[at][c]
        return (total + self._log(self.end[at], self._total(at))) / (len(string) + 1)


class Scanner:
    """An automaton for each kind of credential and one for ordinary tokens, and the spans of a text."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.plain = Automaton(ordinary)
        self.secret = {kind: Automaton(strings) for kind, strings in credentials.items() if strings}
        fits = {kind: sorted(map(a.log_likelihood, credentials[kind])) for kind, a in self.secret.items()}
        self.floor = {kind: f[len(f) // 20] - SLACK for kind, f in fits.items()}

    @property
    def learned(self) -> bool:
        return bool(self.secret)

    def reads_like_secret(self, token: str) -> bool:
        s = symbols(token)
        fits = [fit for kind, a in self.secret.items() if (fit := a.log_likelihood(s)) >= self.floor[kind]]
        return bool(fits) and (max(fits) - self.plain.log_likelihood(s)) * (len(s) + 1) > LEAST_MARGIN

    def secret_parts(self, token: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(start, end) within a candidate that read like a credential: the whole, or else pieces of it; none touches taken."""
        if not taken and self.reads_like_secret(token):
            return [(0, len(token))]
        found = []
        for pieces in PIECES:
            for m in pieces.finditer(token):
                apart = all(e <= m.start() or m.end() <= s for s, e in found + taken)
                if LEAST_LENGTH <= m.end() - m.start() < len(token) and apart and self.reads_like_secret(m.group()):
                    found.append(m.span())
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans, and `format` spans (tokens or pieces that no base span touches), sorted."""
        base = base_spans(text)
        more = []
        for m in CANDIDATE.finditer(text) if self.learned else ():
            taken = [(s - m.start(), e - m.start()) for s, _, e in base if s < m.end() and m.start() < e]
            more += [(m.start() + s, 3, m.start() + e) for s, e in self.secret_parts(m.group(), taken)]
        return sorted(base + more)


def _value(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    return ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def fit(docs: DataFrame, max_strings: int = MAX_STRINGS) -> Scanner:
    """Infer the automata from at most max_strings distinct strings each, those of the least hashes in all documents.

    A task keeps the least hashes of its own rows, so no more than max_strings of a kind leave it. Only symbols
    leave it, not the strings.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    kinds = (*KINDS[:3], "plain")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, str]] = {kind: {} for kind in kinds}

        def add(kind: str, token: str) -> None:
            if len(token) <= MAX_LENGTH:
                kept[kind][xxhash.xxh3_64_intdigest(token.encode()) >> 1] = token
                if len(kept[kind]) > 8 * max_strings:
                    kept[kind] = dict(sorted(kept[kind].items())[:max_strings])

        for batch in batches:
            for scalar in batch.column(0):
                text = scalar.as_py()
                base = base_spans(text)
                for s in base:
                    add(KINDS[s[1]], _value(text, s))
                for m in CANDIDATE.finditer(text):
                    if not any(s < m.end() and m.start() < e for s, _, e in base):
                        add("plain", m.group())
        rows = [(kind, h, symbols(t)) for kind in kinds for h, t in sorted(kept[kind].items())[:max_strings]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["kind", "hash", "string"])

    found = texts.mapInArrow(gather, "kind string, hash long, string string").distinct()
    # in two rounds, as every task hands on max_strings of a kind
    order = ["hash", "string"]
    salted = Window.partitionBy("kind", F.pmod("hash", F.lit(SALTS))).orderBy(*order)
    some = found.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= max_strings).drop("place")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    picked = sorted(some.withColumn("place", place).where(F.col("place") <= max_strings).collect(), key=lambda r: r.place)
    strings = {kind: [r.string for r in picked if r.kind == kind] for kind in kinds}
    return Scanner({kind: strings[kind] for kind in KINDS[:3]}, strings["plain"])


def spans_udf(scanner: Scanner):
    """Column function: text -> array of (kind, start, end), code points, end exclusive, in order."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t.as_py() or "")] for t in texts], span)

    return F.arrow_udf(SPANS)(scan)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs.

    Defined cases: a null text is empty and has no spans; without any labelled credential no `format` span
    is added; repeated rows get the same spans; null doc_ids are allowed; an empty table gives an empty
    result. Only doc_id and text are read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", spans_udf(fit(docs))("text").alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by mark, n_chars recounted where text is not null; same rows and columns.

    Spans that overlap become one mark. Cases as in find_secrets; a null text stays null.
    """
    scanner = fit(docs)

    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in (t.as_py() for t in texts):
                spans = scanner.spans(text or "")
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join(parts) + text[at:] if spans else text)
            yield pa.array(out, pa.string())

    clean = F.arrow_udf("string")(redact)(F.col("text").cast("string"))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns) if "n_chars" in docs.columns else out


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for the whole documents table."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    told = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(told, lambda s: ~s.startswith("format:"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(told, ",").alias("spans"))
