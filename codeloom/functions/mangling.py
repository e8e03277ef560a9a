"""Mangled C++ names read back, once for each distinct name.

The grammar of the Itanium ABI as far as names of program text need it: nested
and template names, constructors, destructors and operators, builtin and
compound types, function types, and substitutions.  A name outside it stays as it is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the ABI: builtin types, standard abbreviations, operators.
BUILTINS = {
    "v": "void", "w": "wchar_t", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int", "l": "long", "m": "unsigned long",
    "x": "long long", "y": "unsigned long long", "n": "__int128", "o": "unsigned __int128", "f": "float", "d": "double", "e": "long double", "g": "__float128", "z": "...", "Dn": "decltype(nullptr)",
}
STANDARD = {"St": "std", "Sa": "std::allocator", "Sb": "std::basic_string", "Ss": "std::string", "Si": "std::istream", "So": "std::ostream", "Sd": "std::iostream"}
OPERATORS = {
    "nw": " new", "na": " new[]", "dl": " delete", "da": " delete[]", "ps": "+", "ng": "-", "ad": "&", "de": "*", "co": "~", "pl": "+", "mi": "-", "ml": "*", "dv": "/", "rm": "%", "an": "&", "or": "|", "eo": "^",
    "aS": "=", "pL": "+=", "mI": "-=", "mL": "*=", "dV": "/=", "rM": "%=", "aN": "&=", "oR": "|=", "eO": "^=", "ls": "<<", "rs": ">>", "lS": "<<=", "rS": ">>=", "eq": "==", "ne": "!=", "lt": "<", "gt": ">",
    "le": "<=", "ge": ">=", "nt": "!", "aa": "&&", "oo": "||", "pp": "++", "mm": "--", "cm": ",", "pm": "->*", "pt": "->", "cl": "()", "ix": "[]",
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class _Reader:
    """One name; ``seen`` holds what may be referred to again."""

    def __init__(self, text: str):
        self.text, self.at, self.seen, self.args = text, 0, [], []

    def take(self, *starts: str) -> str | None:
        for s in starts:
            if self.text.startswith(s, self.at):
                self.at += len(s)
                return s
        return None

    def need(self, start: str) -> None:
        if not self.take(start):
            raise ValueError(start)

    def number(self) -> int:
        end = self.at
        while end < len(self.text) and self.text[end].isdigit():
            end += 1
        n, self.at = int(self.text[self.at : end]), end
        return n

    def keep(self, x: str) -> str:
        self.seen.append(x)
        return x

    def source(self) -> str:
        n = self.number()
        self.at += n
        if self.at > len(self.text):
            raise ValueError("end")
        word = self.text[self.at - n : self.at]
        return "(anonymous namespace)" if word.startswith("_GLOBAL__N") else word

    def reference(self, table: list[str]) -> str:
        """What a base-36 number and an underscore refer to."""
        end = self.text.index("_", self.at)
        digits, self.at = self.text[self.at : end], end + 1
        k = 0
        for d in digits:
            k = 36 * k + _DIGITS.index(d)
        return table[k + 1 if digits else 0]

    def substitution(self) -> str:
        if std := self.take(*STANDARD):
            return STANDARD[std]
        self.need("S")
        return self.reference(self.seen)

    def template_args(self) -> str:
        self.need("I")
        out = []
        while not self.take("E"):
            if self.take("L"):
                kind = self.type()
                end = self.text.index("E", self.at)
                value, self.at = self.text[self.at : end].replace("n", "-"), end + 1
                out.append({"bool": {"0": "false", "1": "true"}.get(value, value), "int": value}.get(kind, f"({kind}){value}"))
            elif self.take("J"):
                while not self.take("E"):
                    out.append(self.type())
            else:
                out.append(self.type())
        self.args = out
        inner = ", ".join(out)
        return f"<{inner}{' ' if inner.endswith('>') else ''}>"

    def templated(self, name: str) -> str:
        return f"{name}{' ' if name.endswith('<') else ''}{self.template_args()}"

    def unqualified(self, around: str) -> str:
        """A name, operator, constructor or destructor; the latter take the class's own name."""
        own = around.split("<", 1)[0].rsplit("::", 1)[-1]
        if self.take("C1", "C2", "C3"):
            return own
        if self.take("D0", "D1", "D2"):
            return f"~{own}"
        if self.text[self.at].isdigit():
            return self.source()
        if self.take("cv"):
            return f"operator {self.type()}"
        if op := self.take(*OPERATORS):
            return f"operator{OPERATORS[op]}"
        raise ValueError(self.text[self.at])

    def nested(self) -> tuple[str, str, bool]:
        """The whole name, what follows its parameters, and whether it ends in template arguments."""
        behind = "".join({"r": " restrict", "V": " volatile", "K": " const"}[x] for x in iter(lambda: self.take("r", "V", "K"), None))
        ref = self.take("R", "O")
        name, template = "", False
        while not self.take("E"):
            if self.text[self.at] == "S":
                name, known = self.substitution(), True
            elif self.text[self.at] == "I":
                name, known, template = self.templated(name), False, True
                self.keep(name)
                continue
            else:
                part, known, template = self.unqualified(name), False, False
                name = f"{name}::{part}" if name else part
            if not known and self.text[self.at] != "E":
                self.keep(name)
        return name, behind + {"R": " &", "O": " &&", None: ""}[ref], template

    def name(self) -> tuple[str, str, bool]:
        if self.take("N"):
            return self.nested()
        if self.take("St"):
            name = f"std::{self.unqualified('')}"
        elif self.text[self.at] == "S":
            name = self.substitution()
            return (self.templated(name), "", True) if self.text[self.at : self.at + 1] == "I" else (name, "", False)
        else:
            self.take("L")
            name = self.unqualified("")
        if self.text[self.at : self.at + 1] == "I":
            self.keep(name)
            return self.templated(name), "", True
        return name, "", False

    def type(self) -> str:
        for mark, sign in (("P", "*"), ("R", "&"), ("O", "&&")):
            if self.take(mark):
                inner = self.type()
                return self.keep(inner.replace(" (", f" ({sign}", 1) if " (" in inner and inner.endswith(")") else inner + sign)
        if self.take("K"):
            return self.keep(f"{self.type()} const")
        if self.take("V"):
            return self.keep(f"{self.type()} volatile")
        if self.take("F"):
            result, params = self.type(), []
            while not self.take("E"):
                params.append(self.type())
            return self.keep(f"{result} ()({', '.join(params) if params != ['void'] else ''})")
        if self.take("A"):
            n = self.number()
            self.need("_")
            return self.keep(f"{self.type()} [{n}]")
        if self.take("T"):
            return self.keep(self.reference(self.args))
        if self.text[self.at : self.at + 1] == "S" and self.text[self.at : self.at + 2] != "St":
            name = self.substitution()
            return self.keep(self.templated(name)) if self.text[self.at : self.at + 1] == "I" else name
        if word := self.take(*BUILTINS):
            return BUILTINS[word]
        return self.keep(self.name()[0])

    def encoding(self) -> str:
        for mark, what in (("TV", "vtable for "), ("TI", "typeinfo for "), ("TS", "typeinfo name for "), ("TT", "VTT for ")):
            if self.take(mark):
                return what + self.type()
        name, behind, template = self.name()
        if self.at == len(self.text) or self.text[self.at] in ".@":
            return name + behind
        special = name.rsplit("::", 1)[-1].split("<", 1)[0]
        ahead = "" if not template or special.startswith(("~", "operator ")) or name.split("<")[0].endswith(f"::{special}::{special}") else f"{self.type()} "
        params = []
        while self.at < len(self.text) and self.text[self.at] not in ".@":
            params.append(self.type())
        return f"{ahead}{name}({', '.join(params) if params != ['void'] else ''}){behind}"


def demangled(name: str) -> str:
    """The name as text, with what stands behind a dot or @ as it is; a name that is not mangled, or not read, as it is."""
    if not name.startswith("_Z"):
        return name
    reader = _Reader(name[2:])
    try:
        out = reader.encoding()
    except (ValueError, IndexError, KeyError, RecursionError):
        return name
    return out + reader.text[reader.at :]


def with_demangled(rows: DataFrame, column: str, name: str = "demangled") -> DataFrame:
    """``rows`` with a column of demangled names; each distinct name is read once and joined back.  Null has null."""

    @F.pandas_udf("string")
    def read(names: pd.Series) -> pd.Series:
        return names.map(demangled)

    made = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, read(column))
    return rows.join(made, column, "left")


def is_destructor(name):
    """Whether a demangled name is that of a destructor."""
    return F.regexp_replace(name, r"\(.*$", "").rlike(r"(^|::)~[^:]*$")
