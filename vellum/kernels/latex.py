"""LaTeX formulas as styled text: a formula is read into a tree of atoms, and the tree is written as runs."""

from __future__ import annotations

import re

from ..functions.text import LOWERED, RAISED
from ..schemas import merged, run

#: Names of letters, signs and functions, and how they are written.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ",
    "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ",
    "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ",
    "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
OPERATORS = {
    "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "·", "circ": "°", "bullet": "•", "star": "⋆", "ast": "∗", "le": "≤", "leq": "≤", "ge": "≥",
    "geq": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "in": "∈",
    "notin": "∉", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "cap": "∩", "cup": "∪", "setminus": "∖", "forall": "∀", "exists": "∃", "nexists": "∄", "lor": "∨",
    "land": "∧", "neg": "¬", "partial": "∂", "nabla": "∇", "infty": "∞", "sum": "∑", "prod": "∏", "coprod": "∐", "int": "∫", "iint": "∬", "iiint": "∭", "oint": "∮",
    "to": "→", "rightarrow": "→", "gets": "←", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔", "iff": "⇔", "uparrow": "↑", "downarrow": "↓", "mapsto": "↦",
    "dots": "…", "ldots": "…", "cdots": "…", "vdots": "⋮", "ddots": "⋱", "angle": "∠", "perp": "⊥", "parallel": "∥", "hbar": "ℏ", "ell": "ℓ", "prime": "′", "quad": "  ",
    "qquad": "    ", ",": " ", ";": " ", ":": " ", "!": "", " ": " ",
}
FUNCTIONS = frozenset(
    "sin cos tan arcsin arccos arctan cot sec csc sinh cosh tanh exp log ln lg lim max min sup inf det gcd dim ker deg arg".split()
)
BLACKBOARD = {"R": "ℝ", "N": "ℕ", "Z": "ℤ", "Q": "ℚ", "C": "ℂ"}
VULGAR = {
    "1/2": "½", "1/3": "⅓", "2/3": "⅔", "1/4": "¼", "3/4": "¾", "1/5": "⅕", "2/5": "⅖", "3/5": "⅗", "4/5": "⅘", "1/6": "⅙", "5/6": "⅚", "1/8": "⅛", "3/8": "⅜", "5/8": "⅝", "7/8": "⅞",
}
ACCENTS = {"vec": "\u20d7", "hat": "\u0302", "bar": "\u0304", "overline": "\u0304", "dot": "\u0307", "ddot": "\u0308", "tilde": "\u0303"}
BIG = frozenset({"sum", "prod", "coprod", "int", "iint", "iiint", "oint", "lim", "max", "min", "sup", "inf"})

TOKEN = re.compile(r"\\([A-Za-z]+|.)|([{}^_])|(\s+)|(.)", re.S)
WRAPPED = ((r"\[", r"\]"), (r"\(", r"\)"), ("$$", "$$"), ("$", "$"))
ENVIRONMENT = re.compile(r"\\(?:begin|end)\{(?:aligned|align\*?|[pb]?matrix|cases|gather\*?)\}")
TAG = re.compile(r"\\tag\{([^}]+)\}")


def shifted(text: str, forms: tuple[str, str], mark: str) -> str:
    """Raised or lowered form if every character has one, else the text behind its mark."""
    if all(c in forms[0] or c == " " for c in text):
        return text.translate(str.maketrans(*forms))
    return mark + text if len(text) == 1 else f"{mark}({text})"


class _Reader:
    def __init__(self, text: str):
        self.tokens = [m for m in TOKEN.finditer(text)]
        self.at = 0

    def peek(self) -> re.Match | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def skip_blanks(self) -> None:
        while (t := self.peek()) and t[3]:
            self.at += 1

    def argument(self) -> list[re.Match]:
        """Tokens of the next group or the next single token."""
        self.skip_blanks()
        t = self.peek()
        if t is None:
            return []
        self.at += 1
        if t[2] != "{":
            return [t]
        depth, start = 1, self.at
        while (t := self.peek()) is not None:
            self.at += 1
            depth += (t[2] == "{") - (t[2] == "}")
            if not depth:
                return self.tokens[start : self.at - 1]
        return self.tokens[start:]

    def option(self) -> str | None:
        """Text in square brackets."""
        self.skip_blanks()
        if not ((t := self.peek()) and t[4] == "["):
            return None
        self.at += 1
        start = self.at
        while (t := self.peek()) and t[4] != "]":
            self.at += 1
        text = "".join(t[0] for t in self.tokens[start : self.at])
        self.at += 1
        return text.strip()


def _plain(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


def _bracketed(runs: list[dict], bold: bool) -> list[dict]:
    return [run("(", bold), *runs, run(")", bold)] if any(c in _plain(runs).strip() for c in "+-= ") else runs


def _written(tokens: list[re.Match], bold: bool = False, upright: bool = False) -> list[dict]:
    reader = _Reader("")
    reader.tokens = tokens
    out: list[dict] = []
    big = False
    while (t := reader.peek()) is not None:
        reader.at += 1
        name, sign, blank, char = t[1], t[2], t[3], t[4]
        was_big, big = big, False
        if name:
            out += _command(name, reader, bold)
            big = name in BIG
        elif sign in ("^", "_"):
            body = _plain(_written(reader.argument(), bold)).strip()
            if was_big:
                reader.skip_blanks()
                nxt = reader.peek()
                if sign == "_" and nxt is not None and nxt[2] == "^":
                    reader.at += 1
                    upper = _plain(_written(reader.argument(), bold)).strip()
                    out.append(run(f"({body}..{upper})", bold))
                    continue
                out.append(run(f"({body})", bold) if sign == "_" else run(shifted(body, RAISED, "^"), bold))
            else:
                out.append(run(shifted(body, RAISED if sign == "^" else LOWERED, sign), bold))
        elif sign == "{":
            reader.at -= 1
            out += _written(reader.argument(), bold, upright)
        elif blank:
            out.append(run("\n" if "\n" in blank else " ", bold))
        elif char:
            out.append(run(char, bold, italic=not upright and char.isascii() and char.isalpha()))
    return out


def _command(name: str, reader: _Reader, bold: bool) -> list[dict]:
    if name in ("frac", "dfrac", "tfrac"):
        top, bottom = _written(reader.argument(), bold), _written(reader.argument(), bold)
        whole = VULGAR.get(f"{_plain(top).strip()}/{_plain(bottom).strip()}")
        return [run(whole, bold)] if whole else [*_bracketed(top, bold), run(" / ", bold), *_bracketed(bottom, bold)]
    if name == "sqrt":
        degree = reader.option()
        sign = {None: "√", "2": "√", "3": "∛", "4": "∜"}.get(degree) or shifted(degree, RAISED, "^") + "√"
        return [run(sign + "(", bold), *_written(reader.argument(), bold), run(")", bold)]
    if name in ("text", "mathrm", "operatorname", "textrm"):
        return [run("".join(t[0] for t in reader.argument()), bold)]
    if name in ("mathbf", "boldsymbol", "textbf"):
        return _written(reader.argument(), True)
    if name in ("mathit", "mathcal"):
        return _written(reader.argument(), bold)
    if name == "mathbb":
        text = "".join(t[0] for t in reader.argument()).strip()
        return [run(BLACKBOARD.get(text[:1], text), bold)]
    if name in ACCENTS:
        return [run(_plain(_written(reader.argument(), bold)).strip() + ACCENTS[name], bold, True)]
    if name in ("left", "right"):
        reader.skip_blanks()
        t = reader.peek()
        if t is not None:
            reader.at += 1
            return [] if t[0] == "." else [run((t[1] or t[0]).replace("\\", ""), bold)]
        return []
    if name in GREEK:
        return [run(GREEK[name], bold)]
    if name in OPERATORS:
        return [run(OPERATORS[name], bold)]
    if name in FUNCTIONS:
        return [run(name, bold)]
    return [run(name, bold)]


def formula_runs(latex: str | None) -> list[dict]:
    """Runs of a formula: single letters are italic, a tag follows at the end in brackets.

    Null and blank formulas give no runs; unknown commands are written by name; unclosed groups end with
    the formula.
    """
    text = (latex or "").strip()
    for a, b in WRAPPED:
        if text.startswith(a) and text.endswith(b) and len(text) >= len(a) + len(b):
            text = text[len(a) : -len(b)].strip()
            break
    if not text:
        return []
    tag = TAG.search(text)
    if tag:
        text = text.replace(tag[0], "").strip()
    text = ENVIRONMENT.sub("", text).replace("\\\\", "\n").replace("&", " ")
    out = _written(_Reader(text).tokens)
    if tag:
        out.append(run(f"    ({tag[1].strip()})"))
    return merged(out)
