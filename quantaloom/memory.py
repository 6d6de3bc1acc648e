"""What a mining run remembers: formulas that worked, formulas that resemble others, insights, rejections, and how full each domain is."""

from __future__ import annotations

import time
from collections import Counter, deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from quantaloom.sources.stores import load_json, save_json

WEEK = 7 * 86400.0
#: Admissions that fill a domain.
FULL = 20
#: How many notes of each kind are kept.
KEEP = {"worked": 30, "alike": 50, "insights": 20, "rejected": 30}
#: Domains by the first of their words that a formula or its explanation holds.
DOMAINS = (
    ("momentum", ("momentum", "动量", "ts_delta", "ts_lag")),
    ("reversal", ("revers", "反转", "mean_revert")),
    ("volatility", ("volatil", "波动", "ts_std", "ts_kurt", "ts_skew")),
    ("volume_price", ("volume", "量", "amount", "turnover", "成交")),
    ("correlation", ("corr", "相关", "cov")),
)


def domain(formula: str, logic: str = "") -> str:
    text = f"{formula} {logic}".lower()
    return next((name for name, words in DOMAINS if any(w in text for w in words)), "other")


@dataclass(frozen=True)
class Note:
    """A formula or a sentence, why it is remembered (an admission's or a rejection's code), and since when."""

    text: str
    code: str = ""
    logic: str = ""
    figures: dict[str, float] = field(default_factory=dict)
    at: float = 0.0

    def line(self) -> str:
        shown = [self.code, *(f"{k} {v:.4g}" for k, v in self.figures.items()), self.logic]
        return f"- {self.text}: {', '.join(x for x in shown if x)}" if any(shown) else f"- {self.text}"


@dataclass
class Tally:
    """Counts of a run so far; ``share`` is that of the last round's proposals that were admitted."""

    rounds: int = 0
    proposed: int = 0
    admitted: int = 0
    share: float = 0.0
    by_domain: dict[str, int] = field(default_factory=dict)

    def fullness(self) -> dict[str, float]:
        return {name: min(1.0, n / FULL) for name, n in self.by_domain.items()}


def _known(kind: type, values: Any) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in values.items() if k in names} if isinstance(values, dict) else {}


class ExperienceMemory:
    """Notes of four kinds, a bounded number of each, and a tally, in a JSON file that is rewritten after each change."""

    def __init__(self, path: str | Path, clock: Callable[[], float] = time.time) -> None:
        self.path, self.clock = Path(path), clock
        stored = load_json(self.path, {})
        stored = stored if isinstance(stored, dict) else {}
        self.tally = Tally(**_known(Tally, stored.get("tally")))
        self.notes = {kind: deque((Note(**_known(Note, n)) for n in stored.get(kind, []) if isinstance(n, dict) and "text" in n), maxlen=most) for kind, most in KEEP.items()}

    def dump(self) -> dict[str, Any]:
        return {"tally": asdict(self.tally), **{kind: [asdict(n) for n in own] for kind, own in self.notes.items()}}

    def retrieve(self, library_size: int) -> dict[str, str]:
        """What a proposer is told: how the run stands, and the last notes of each kind."""
        t = self.tally
        stand = [f"{library_size} formulas in the library after {t.rounds} rounds; {t.share:.0%} of the last round's were admitted"]
        stand += [f"{name}: {share:.0%} full" for name, share in sorted(t.fullness().items(), key=lambda x: (-x[1], x[0]))]
        told = {"state": "\n".join(stand)}
        for kind, n in (("worked", 10), ("alike", 10), ("rejected", 5), ("insights", 5)):
            told[kind] = "\n".join(note.line() for note in list(self.notes[kind])[-n:])
        return told

    def formation(self, results: Sequence[Mapping[str, Any]]) -> None:
        """Take in a round's results (expression, logic, admitted, code, figures)."""
        now, t = self.clock(), self.tally
        known = {n.text for n in self.notes["worked"]}
        for r in results:
            note = Note(r["expression"], r.get("code", ""), r.get("logic", ""), dict(r.get("figures", {})), now)
            if r["admitted"]:
                where = domain(note.text, note.logic)
                t.by_domain = dict(Counter(t.by_domain) + Counter({where: 1}))
                if note.text not in known:
                    self.notes["worked"].append(note)
                continue
            self.notes["rejected"].append(note)
            if note.code == "alike":
                self.notes["alike"].append(note)
        if results:
            n = sum(bool(r["admitted"]) for r in results)
            t.proposed, t.admitted, t.share = t.proposed + len(results), t.admitted + n, n / len(results)
        save_json(self.path, self.dump())

    def evolution(self, insights: Sequence[str] = ()) -> None:
        """Take in new insights, and forget what is older than a week of what worked or was alike."""
        now = self.clock()
        for text in dict.fromkeys(insights):
            if all(n.text != text for n in self.notes["insights"]):
                self.notes["insights"].append(Note(text, at=now))
        for kind in ("worked", "alike"):
            fresh = [n for n in self.notes[kind] if n.at > now - WEEK]
            self.notes[kind].clear()
            self.notes[kind].extend(fresh)
        save_json(self.path, self.dump())

    def snapshot(self) -> dict[str, Any]:
        """The whole memory, and how full each domain is; of the rejections the last ten."""
        out = self.dump() | {"fullness": self.tally.fullness()}
        return out | {"rejected": out["rejected"][-10:]}
