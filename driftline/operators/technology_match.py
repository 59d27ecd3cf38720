"""Matching many technology rules at once: one automaton over the fixed parts of all rules is run over a value, and a rule's pattern is
tried only in a window around its own fixed part."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Characters before and after a fixed part in which a rule's pattern is looked for.
WINDOW = 200
#: Fixed parts shorter than this say too little: such a rule's pattern is tried on every value of its kind.
LEAST_PART = 3
_REPEATS = ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT")

#: (name, category, kind, pattern or weak parts, weak parts needed)
Rule = tuple


def _parts(parsed) -> frozenset[str] | None:
    """Texts one of which every match holds, the best such set: that whose shortest text is longest. None if there is none."""
    best: frozenset[str] | None = None
    run = ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            run += chr(arg).lower()
            continue
        if kind == "AT":  # a place, no character
            continue
        inner = None
        if kind == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in arg[-1]):
            run += "".join(chr(a).lower() for _, a in arg[-1])
            continue
        if kind == "SUBPATTERN":
            inner = _parts(arg[-1])
        elif kind in _REPEATS and arg[0] > 0:
            inner = _parts(arg[2])
        elif kind == "BRANCH":
            each = [_parts(x) for x in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        offer(frozenset([run]) if run else None)
        offer(inner)
        run = ""
    offer(frozenset([run]) if run else None)
    return best


def fixed_parts(pattern: str) -> frozenset[str] | None:
    found = _parts(re._parser.parse(pattern, re.IGNORECASE))
    return found if found and min(map(len, found)) >= LEAST_PART else None


class Matcher:
    """The rules of one kind of signal. A rule is (name, category, kind, pattern), with version in the pattern's group, or weak: (name,
    category, kind, fixed texts, how many different ones have to be there). Hosts are (name, category, "host", domain): the domain itself
    or any host below it."""

    def __init__(self, rules: list[Rule], kind: str):
        import ahocorasick

        self.hosts: dict[str, list[Rule]] = {}
        self.always: list[int] = []
        self.rules: list[tuple] = []
        texts: dict[str, list[int]] = {}
        for rule in rules:
            if rule[2] != kind:
                continue
            if kind == "host":
                self.hosts.setdefault(rule[3], []).append(rule)
                continue
            k, weak = len(self.rules), len(rule) > 4
            self.rules.append((rule[0], rule[1], None if weak else re.compile(rule[3], re.IGNORECASE | re.ASCII), rule[4] if weak else 0, "+".join(rule[3]) if weak else rule[3]))
            own = frozenset(x.lower() for x in rule[3]) if weak else fixed_parts(rule[3])
            if own is None:
                self.always.append(k)
            for x in own or ():
                texts.setdefault(x, []).append(k)
        self.automaton = ahocorasick.Automaton() if texts else None
        for x, owners in texts.items():
            self.automaton.add_word(x, (len(x), x, owners))
        if texts:
            self.automaton.make_automaton()

    def _found(self, pattern: re.Pattern, value: str, low: int, high: int) -> re.Match | None:
        at = low
        while m := pattern.search(value, at, high):
            # an end of the window isn't an end of the value
            if m.end() < high or high == len(value):
                return m
            if whole := pattern.match(value, m.start()):
                return whole
            at = m.start() + 1
        return None

    def matches(self, value: str) -> Iterator[tuple[str, str, str | None, str]]:
        """(name, category, version, evidence) of every rule that the value shows, once a rule."""
        if self.hosts:
            labels = value.lower().rstrip(".").split(".")
            for k in range(len(labels)):
                for name, category, _, domain in self.hosts.get(".".join(labels[k:]), ()):
                    yield name, category, None, domain
            return
        done: set[int] = set()
        weak: dict[int, set[str]] = {}

        def told(k: int, m: re.Match):
            done.add(k)
            name, category, pattern, _, evidence = self.rules[k]
            version = m.group(1) if pattern.groups else None
            return name, category, version or None, evidence

        for k in self.always:
            if m := self.rules[k][2].search(value):
                yield told(k, m)
        if self.automaton is None:
            return
        for end, (size, text, owners) in self.automaton.iter(value.lower() if len(value.lower()) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)):
            for k in owners:
                if k in done:
                    continue
                name, category, pattern, least, evidence = self.rules[k]
                if least:
                    seen = weak.setdefault(k, set())
                    seen.add(text)
                    if len(seen) >= least:
                        done.add(k)
                        yield name, category, None, evidence
                elif m := self._found(pattern, value, max(0, end + 1 - size - WINDOW), min(len(value), end + 1 + WINDOW)):
                    yield told(k, m)


@lru_cache(maxsize=32)
def matcher(rules: tuple[Rule, ...], kind: str) -> Matcher:
    """Built once a worker."""
    return Matcher(list(rules), kind)
