r"""URL filter: all glob rules at once by a bit-parallel wildcard automaton.

A glob is literal bytes with ``*`` (any run without ``/``) and ``**`` (any run).
Every literal byte of every rule is one bit of a state of several 64-bit words,
and every rule has a start bit before its first. One step over byte c is

    D = ((D << 1) & B[c]) | (D & G[c])

B[c] has the bits whose literal is c; G[c] has the bits after which a star that
may take c follows. Start bits are in no B, so no bit moves from one rule into
the next. A numpy array holds the states of many URLs, one row each, so each
step advances all of them; URLs are sorted by length, and those that ended leave.

Defined results: a null URL, or one without ``://``, has empty host and path and
no glob that needs a byte fits it. Repeated rows are judged each by itself.
Longer URLs take more steps, never fewer; none is cut. An empty table gives no
rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path start, verdict): a rule fits the host and its subdomains; the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Globs over host and path that block where no rule fits; everything else is allowed.
BLOCKED = ("*spam-farm*", "*spam-farm*/**", "*cheap-pills*", "*cheap-pills*/**", "*casino*", "*casino*/**", "**/wp-login.php", "**/ads/**")
#: Bytes of a matrix of URLs that step together.
BLOCK_BYTES = 8 << 20


class GlobSet:
    """Globs compiled into masks; ``match`` tells for each text which of them fit it whole."""

    def __init__(self, globs: Sequence[str]) -> None:
        literals: list[tuple[int, int]] = []  # bit, byte
        stays: list[tuple[int, bool]] = []  # bit, whether "/" stays too
        self.start, self.final, bit = [], [], 0
        for glob in globs:
            self.start.append(bit)
            for part in re.findall(rb"\*+|[^*]", glob.encode(), re.S):
                if part[:1] == b"*":
                    stays.append((bit, len(part) > 1))
                else:
                    bit += 1
                    literals.append((bit, part[0]))
            self.final.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.step, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for at, byte in literals:
            self.step[byte, at // 64] |= np.uint64(1 << at % 64)
        for at, slash in stays:
            which = [c for c in range(256) if slash or c != 0x2F]
            self.stay[which, at // 64] |= np.uint64(1 << at % 64)
        self.begin = np.zeros(self.words, np.uint64)
        for at in self.start:
            self.begin[at // 64] |= np.uint64(1 << at % 64)

    def _run(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        wide = int(lengths.max(initial=0))
        chars = np.zeros((len(texts), wide), np.uint8)
        for i, t in enumerate(texts):
            chars[i, : len(t)] = np.frombuffer(t, np.uint8)
        state = np.tile(self.begin, (len(texts), 1))
        alive = np.searchsorted(-lengths, -np.arange(wide), side="left")  # how many are longer than t
        for t in range(wide):
            n = alive[t]
            c, d = chars[:n, t], state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (d & self.stay[c])
        return state

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean for each text and glob."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out = np.zeros((len(texts), len(self.final)), bool)
        a = 0
        while a < len(order):
            b = a + max(1, BLOCK_BYTES // max(1, len(texts[order[a]])))
            state = self._run([texts[i] for i in order[a:b]])
            for k, at in enumerate(self.final):
                out[order[a:b], k] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
            a = b
        return out


def judge(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Per page: page_id, host, path, rule (or null), verdict (allow or block)."""
    rules = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    globs = [g for host, path, _ in rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(blocked)
    names = pa.array([h + p for h, p, _ in rules] + [None], pa.string())
    says = np.array([v for _, _, v in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                texts = [(h + p).encode() for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                hit = automaton.match(texts)
                own = hit[:, : 2 * len(rules)].reshape(len(texts), len(rules), 2).any(2)
                which = np.where(own.any(1), own.argmax(1), len(rules))
                free = np.where(hit[:, 2 * len(rules) :].any(1), "block", "allow")
                verdict = np.where(which < len(rules), np.append(says, "")[which], free)
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(pa.array(which)), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.translate(F.regexp_extract(text, pattern, 1), upper, lower).alias("host"), F.regexp_extract(text, pattern, 2).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages
), r as (
  select *, case
    when '.' || host like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when '.' || host like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when '.' || host like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when '.' || host like '%.net' and starts_with(path, '/') then 'net/' end as rule
  from u
)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block'
    when rule is not null then 'allow'
    when contains(host, 'spam-farm') or contains(host, 'cheap-pills') or contains(host, 'casino')
      or path like '%/wp-login.php' or contains(path, '/ads/') then 'block'
    else 'allow' end as verdict
from r
"""
