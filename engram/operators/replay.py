"""Turns in order: the exact mode, where each write sees what all writes before it did to its bank.

Banks are independent, so each is folded on its own (``applyInPandas`` by bank); within a bank, order is the meaning. The
set-based operators decide against a frozen bank instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from engram.functions.rules import BASELINE_ANSWER, JOB_ANSWER, JOB_DESCRIPTION, NO_CONTEXT, NO_DOGS, NO_NAME
from engram.schema import Params

TURN_OUT = "bank_id string, turn long, op string, note_id string, query string, used array<string>, answer string, notes long"
_QUESTION = re.compile(r"(what|who|where|when|how|which|do|does|is|are)\b", re.IGNORECASE)
_PETS = ("buddy", "scout")


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _distinct(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(x for part in lists for x in part))


def _pets(text: str) -> list[str]:
    named = [x.lower() for x in re.findall(r"named\s+([A-Za-z]+)", text)]
    return _distinct(named or [p for p in _PETS if p in text.lower()])


def _name(text: str) -> str | None:
    m = re.search(r"name is\s+([a-z]+)", text.lower())
    return m[1] if m else None


@dataclass
class Memory:
    """One bank: notes by id in the order of their last write."""

    p: Params
    notes: dict[str, dict] = field(default_factory=dict)

    def embed(self, text: str) -> np.ndarray:
        import hashlib

        v = np.zeros(self.p.dim)
        for t in _tokens(text) or ["empty"]:
            v[hashlib.md5(t.encode()).digest()[-1] % self.p.dim] += 1
        return v / np.linalg.norm(v)

    def build(self, note_id: str, content: str) -> dict:
        text, k, g = content.strip(), [], []
        low, about = text.lower(), content.strip()
        if name := _name(text):
            k, g, about = [name, "name", "identity"], ["profile", "personal"], f"User's name is {name.title()}."
        if any(w in low for w in ("dog", *_PETS)):
            pets = _pets(text)
            k, g = [*k, "dog", "pet", *pets], [*g, "pets"]
            if pets:
                about = f"User has dog(s): {', '.join(p.title() for p in pets)}."
        if any(w in low for w in ("work", "job", "scientist")):
            k, g, about = [*k, "job", "career", "data scientist"], [*g, "career", "professional"], JOB_DESCRIPTION
        if not k:
            k, g = _tokens(text)[:4] or ["general"], ["general"]
        k, g = _distinct(k), _distinct(g)
        return {"id": note_id, "c": content, "K": k, "G": g, "X": about, "e": self.embed(" ".join([content, " ".join(k), " ".join(g), about])), "L": [], "q": self.p.q0}

    def put(self, note: dict) -> None:
        self.notes.pop(note["id"], None)
        self.notes[note["id"]] = note

    def near(self, vector: np.ndarray, k: int) -> list[tuple[float, dict]]:
        """Most similar first; equal ones in the order of writes."""
        scored = [(float(n["e"] @ vector) / (np.linalg.norm(n["e"]) * np.linalg.norm(vector) or 1.0), n) for n in self.notes.values()]
        return sorted(scored, key=lambda x: -x[0])[:k]

    def write(self, note_id: str, content: str) -> tuple[str, str | None]:
        new = self.build(note_id, content)
        if "?" in content or _QUESTION.match(content.strip()):
            return "NOOP", None
        wanted = {x.lower() for x in new["K"]}
        target = next((n for n in self.notes.values() if wanted & {x.lower() for x in n["K"]}), None)
        if target:
            new |= {"id": target["id"], "L": target["L"], "q": target["q"]}
        self.put(new)
        if self.p.link:
            self.connect(new)
        return ("UPDATE" if target else "ADD"), new["id"]

    def connect(self, new: dict) -> None:
        """Link with the nearest two of the neighbours, then merge the new note's fields into every neighbour, itself included."""
        fresh = {x: list(new[x]) if x != "X" else new[x] for x in "KGX"}
        around = [n for _, n in self.near(new["e"], self.p.k)]
        for n in [n for n in around if n is not new][:2]:
            n["L"], new["L"] = _distinct(n["L"], [new["id"]]), _distinct(new["L"], [n["id"]])
            self.put(n)
        if len(around) > 1:
            self.put(new)
        for n in around:
            n["K"], n["G"] = _distinct(n["K"], fresh["K"]), _distinct(n["G"], fresh["G"])
            old, extra = n["X"].strip(), fresh["X"].strip()
            n["X"] = f"{old} | Related update: {extra}".strip(" |") if extra else old
            self.put(n)

    def retrieve(self, query: str) -> list[dict]:
        pool = [(s, n) for s, n in self.near(self.embed(query), self.p.k1) if s > self.p.delta]
        if not pool:
            return []
        columns = []
        for x in (np.array([s for s, _ in pool]), np.array([n["q"] for _, n in pool])):
            spread = x.std()
            columns.append(x if not self.p.use_zscore else (x - x.mean()) / spread if spread >= 1e-12 else np.zeros(len(x)))
        score = (1 - self.p.lam) * columns[0] + self.p.lam * columns[1]
        return [pool[i][1] for i in np.argsort(-score, kind="stable")[: self.p.k2]]

    def answer(self, query: str) -> tuple[list[dict], str]:
        pool = self.retrieve(query)
        if not pool:
            return [], BASELINE_ANSWER
        asked, low = set(_tokens(query)), query.lower()
        score = [len(asked & set(_tokens(n["c"]))) + len(asked & {x.lower() for x in n["K"]}) + n["q"] for n in pool]
        used = [pool[i] for i in np.argsort(-np.array(score), kind="stable")[:2]]
        if "dog" in low or "pet" in low:
            dogs = _distinct(*[_pets(n["c"]) + [x.lower() for x in n["K"] if x.lower() in _PETS] for n in used])
            return used, f"You have two dogs: {', '.join(d.title() for d in dogs)}." if dogs else NO_DOGS
        if any(w in low for w in ("job", "work", "career")):
            return used, JOB_ANSWER
        if "name" in low or "who am i" in low:
            name = next(filter(None, (_name(n["c"]) for n in used)), None)
            return used, f"Your name is {name.title()}." if name else NO_NAME
        return used, used[0]["c"] or NO_CONTEXT

    def reward(self, used: list[dict], reward: float) -> None:
        for n in used:
            if n["id"] in self.notes:
                n["q"] += self.p.alpha * (reward - n["q"])
                self.put(n)

    def turn(self, turn: int, content: str | None, query: str | None, reward: float | None) -> tuple[str | None, str | None, list[str], str | None]:
        op = note_id = reply = None
        used: list[dict] = []
        if content is not None:
            op, note_id = self.write(f"n{turn}", content)
        if query is not None:
            used, reply = self.answer(query)
            if reward is not None:
                self.reward(used, reward)
                self.put(self.build(f"s{turn}", f"Query: {query.strip()} | Answer: {reply.strip()} | Reward: {reward}"))
        return op, note_id, [n["id"] for n in used], reply


def replay(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """turns (bank_id, turn, content, query, reward), nulls for what a turn lacks -> what each turn did, see TURN_OUT."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        memory, out = Memory(p), []
        for t in frame.sort_values("turn", kind="stable").itertuples():
            content, query, reward = (None if pd.isna(x) else x for x in (t.content, t.query, t.reward))
            op, note_id, used, reply = memory.turn(t.turn, content, query, reward)
            out.append((t.bank_id, t.turn, op, note_id, query, used, reply, len(memory.notes)))
        return pd.DataFrame(out, columns=["bank_id", "turn", "op", "note_id", "query", "used", "answer", "notes"])

    return turns.select("bank_id", "turn", "content", "query", "reward").groupBy("bank_id").applyInPandas(fold, TURN_OUT)
