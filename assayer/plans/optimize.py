"""Prompts and their optimisation: small loops on the driver around distributed scoring."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

MASK = (1 << 64) - 1


class PromptError(ValueError):
    pass


KINDS = {"text": str, "number": (int, float), "boolean": bool}


def render(template: str, values: dict[str, str | float | bool], language: str | None = None, kinds: dict[str, str] | None = None) -> str:
    """Puts values for {{names}}; one that is missing is an error, and so is one of another kind (text,
    number or boolean) than kinds asks for, and what is left of braces."""
    for name, kind in (kinds or {}).items():
        v = values.get(name)
        if name not in values:
            raise PromptError(f"no value for {name}")
        if not isinstance(v, KINDS[kind]) or kind == "number" and isinstance(v, bool):
            raise PromptError(f"{name} must be a {kind}")

    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise PromptError(f"no value for {m[1]}")
        v = values[m[1]]
        return str(v).lower() if isinstance(v, bool) else str(v)

    out = re.sub(r"\{\{\s*(\w+)\s*\}\}", put, template)
    left = re.search(r"\{\{[^}]*\}\}", re.sub(r"\{\{\s*(\w+)\s*\}\}", "", template))
    if left:
        raise PromptError(f"cannot be filled: {left[0]}")
    return f"Answer in {language}.\n{out}" if language else out


def differences(made: dict, expected: dict) -> list[str]:
    """Fields in which a made sample departs from an expected one, by name."""
    return [f"{k}: {made.get(k)!r} is not {expected.get(k)!r}" for k in sorted({*made, *expected}) if made.get(k) != expected.get(k)]


def trial_plan(instructions: int, demonstrations: int, trials: int, seed: int = 42) -> list[tuple[int, int, int]]:
    """(trial, instruction, demonstration set) of a search over both, drawn from the seed."""
    if min(instructions, demonstrations, trials) < 1:
        raise PromptError("a plan needs instructions, demonstrations and trials")
    out = []
    for t in range(trials):
        seed = next_seed(seed)
        out.append((t, (seed >> 33) % instructions, (seed >> 17) % demonstrations))
    return out


def fnv1a(data: bytes) -> str:
    """The 64-bit FNV-1a hash, in 16 digits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & MASK
    return f"{h:016x}"


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def cache_key(function: str, arguments: dict) -> str:
    """A stable key of a call; callbacks do not count and secrets are masked first."""
    secret = re.compile("authorization|api_?key|token|secret|password", re.I)
    clean = {k: "***" if secret.search(k) else v for k, v in arguments.items() if k != "callbacks"}
    return fnv1a(canonical_json([function, clean]).encode())


def next_seed(seed: int) -> int:
    # Knuth's linear congruential generator.
    return (seed * 6364136223846793005 + 1442695040888963407) & MASK


def crossover(a: str, b: str, seed: int) -> str:
    """Words of a up to a cut, then those of b from it."""
    x, y = a.split(), b.split()
    cut = seed % (min(len(x), len(y)) + 1)
    return " ".join(x[:cut] + y[cut:])


@dataclass
class Genetic:
    """An elite strategy: the two best prompts of a generation are parents of the next."""

    seed: int = 42
    generations: int = 3
    population: int = 4
    history: list[tuple[int, str, float]] = field(default_factory=list)

    def run(self, start: list[str], score: Callable[[list[str]], list[float]], mutate: Callable[[str, int], str]) -> tuple[str, float]:
        """score takes a generation at once, so that it can be one distributed job."""
        seed, current, best = self.seed, list(start), None
        while len(current) < self.population:
            seed = next_seed(seed)
            current.append(mutate(start[len(current) % len(start)], seed))
        for g in range(self.generations + 1):
            scored = list(zip(current, score(current), strict=True))
            self.history += [(g, p, s) for p, s in scored]
            ranked = sorted(enumerate(scored), key=lambda x: (-x[1][1], x[0]))
            top = ranked[0][1]
            if best is None or top[1] > best[1]:
                best = top
            parents = [p for _, (p, _) in ranked[:2]]
            current = parents[: self.population]
            while len(current) < self.population:
                seed = next_seed(seed)
                current.append(mutate(crossover(parents[0], parents[-1], seed), seed))
        return best
