"""A minimal acyclic transducer: sorted words in, sequences of numbers out.

Words share prefixes and suffixes.  A path's output is the concatenation of the
outputs on its arcs and of its last state's own; each output stands as near to
the start as it can, so that states with equal futures become one state.  The
automaton is built from sorted words in one pass: states behind the part that a
word shares with the next are final and are replaced by an equal one where the
register has it.

The compiled form is a file of flat arrays, which a reader maps into memory:
every process of a machine shares its pages, and nothing is parsed on opening.
"""

from __future__ import annotations

import mmap
from array import array
from bisect import bisect_left
from collections.abc import Iterable

Output = tuple[int, ...]

#: Names of the arrays in the file, in order; all hold 32-bit integers.
_ARRAYS = ("first", "label", "target", "arc_output", "final_output", "start", "pool")


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: dict[str, list] = {}  # character -> [output, target]
        self.final: Output | None = None


def _common(a: Output, b: Output) -> Output:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return a[:k]


def compile_words(pairs: Iterable[tuple[str, Output]]) -> bytes:
    """The file for distinct words and their outputs, in code-point order of the words."""
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state: _State) -> int:
        key = (state.final, tuple((c, out, to) for c, (out, to) in sorted(state.arcs.items())))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    def freeze_behind(shared: int) -> None:
        for i in range(len(path) - 1, shared, -1):
            path[i - 1].arcs[last[i - 1]][1] = freeze(path[i])
        del path[shared + 1 :]

    path, last = [_State()], ""
    for word, output in pairs:
        if word <= last and (last or path[0].final is not None):
            raise ValueError("words must be distinct and sorted")
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        freeze_behind(shared)
        for i in range(shared):
            arc = path[i].arcs[word[i]]
            keep = _common(arc[0], output)
            rest, arc[0], output = arc[0][len(keep) :], keep, output[len(keep) :]
            if rest:  # what the arc no longer gives is given behind it
                below = path[i + 1]
                for further in below.arcs.values():
                    further[0] = rest + further[0]
                if below.final is not None:
                    below.final = rest + below.final
        for i in range(shared, len(word)):
            path[i].arcs[word[i]] = [output if i == shared else (), None]
            path.append(_State())
        path[-1].final = output if shared == len(word) else ()
        last = word
    freeze_behind(0)
    root = freeze(path[0])

    outputs: dict[Output, int] = {(): 0}
    columns = {name: array("i") for name in _ARRAYS}
    for final, arcs in frozen:
        columns["first"].append(len(columns["label"]))
        columns["final_output"].append(-1 if final is None else outputs.setdefault(final, len(outputs)))
        for c, out, to in arcs:
            columns["label"].append(ord(c))
            columns["target"].append(to)
            columns["arc_output"].append(outputs.setdefault(out, len(outputs)))
    columns["first"].append(len(columns["label"]))
    for out in outputs:
        columns["start"].append(len(columns["pool"]))
        columns["pool"].extend(out)
    columns["start"].append(len(columns["pool"]))
    return b"".join([array("i", [root, *(len(columns[n]) for n in _ARRAYS)]).tobytes(), *(columns[n].tobytes() for n in _ARRAYS)])


class Transducer:
    """Reads a compiled file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        head = 4 * (1 + len(_ARRAYS))
        self.root, *sizes = view[:head].cast("i")
        for name, n in zip(_ARRAYS, sizes, strict=True):
            setattr(self, name, view[head : head + 4 * n].cast("i"))
            head += 4 * n
        self.states, self.arcs = sizes[0] - 1, sizes[1]

    def output(self, k: int) -> list[int]:
        return list(self.pool[self.start[k] : self.start[k + 1]])

    def path(self, word: str) -> list[int] | None:
        """The numbers of the outputs on the word's path, empty ones left out, or None for a word outside the lexicon."""
        state, out = self.root, []
        first, label, output, target = self.first, self.label, self.arc_output, self.target
        for c in map(ord, word):
            end = first[state + 1]
            at = bisect_left(label, c, first[state], end)
            if at == end or label[at] != c:
                return None
            if output[at]:
                out.append(output[at])
            state = target[at]
        last = self.final_output[state]
        if last > 0:
            out.append(last)
        return None if last < 0 else out

    def look(self, word: str) -> list[int] | None:
        """The word's output, or None for a word outside the lexicon."""
        path = self.path(word)
        return None if path is None else [x for k in path for x in self.output(k)]
