"""Office math to LaTeX."""

from __future__ import annotations

import unicodedata
from xml.etree.ElementTree import Element

# LaTeX names of marks over and under an expression, of operators, relations and functions.
OVER_UNDER = {
    "̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overbar", "̆": "breve", "̇": "dot",
    "̈": "ddot", "̉": "ovhook", "̊": "ocirc", "̌": "check", "̐": "candra", "̒": "oturnedcomma", "̕": "ocommatopright",
    "̚": "droang", "̸": "not", "⃐": "leftharpoonaccent", "⃑": "rightharpoonaccent", "⃒": "vertoverlay", "⃖": "overleftarrow",
    "⃗": "vec", "⃛": "dddot", "⃜": "ddddot", "⃡": "overleftrightarrow", "⃧": "annuity", "⃩": "widebridgeabove", "⃰": "asteraccent",
    "̰": "wideutilde", "̱": "underbar", "⃨": "threeunderdot", "⃬": "underrightharpoondown", "⃭": "underleftharpoondown",
    "⃮": "underleftarrow", "⃯": "underrightarrow", "⎴": "overbracket", "⏜": "overparen", "⏞": "overbrace", "⎵": "underbracket",
    "⏝": "underparen", "⏟": "underbrace",
}
OPERATORS = {"⅀": "Bbbsum", "∏": "prod", "∐": "coprod", "∑": "sum", "∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint", "⋀": "bigwedge", "⋁": "bigvee", "⋂": "bigcap", "⋃": "bigcup", "⨀": "bigodot", "⨁": "bigoplus", "⨂": "bigotimes"}
RELATIONS = {
    "←": "leftarrow", "↑": "uparrow", "→": "rightarrow", "↓": "downarrow", "↔": "leftrightarrow", "↕": "updownarrow", "↖": "nwarrow", "↗": "nearrow", "↘": "searrow", "↙": "swarrow",
    "⋮": "vdots", "⋯": "cdots", "⋰": "adots", "⋱": "ddots", "≠": "ne", "≤": "leq", "≥": "geq", "≦": "leqq", "≧": "geqq", "≨": "lneqq", "≩": "gneqq", "≪": "ll", "≫": "gg",
    "∈": "in", "∉": "notin", "∋": "ni", "∌": "nni", "∞": "infty", "±": "pm", "∓": "mp", "×": "times", "÷": "div", "∂": "partial", "∇": "nabla", "∀": "forall", "∃": "exists",
}
FUNCTIONS = frozenset("sin cos tan arcsin arccos arctan arccot sinh cosh tanh coth sec csc cot log ln exp".split())
LIMITS = frozenset(["lim", "max", "min", "sup", "inf"])
SPECIAL = frozenset("{}_^#&$%~")
_GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split())


def symbol(c: str) -> str:
    """A character of math: letters of the italic alphabets become plain, Greek ones and signs commands."""
    if c in RELATIONS:
        return f"\\{RELATIONS[c]} "
    if c in OPERATORS:
        return f"\\{OPERATORS[c]} "
    plain = unicodedata.normalize("NFKC", c) if ord(c) >= 0x1D400 else c
    if len(plain) == 1 and "GREEK" in (name := unicodedata.name(plain, "")):
        word = name.rpartition(" ")[2].lower().replace("lamda", "lambda")
        if word in _GREEK:
            return f"\\{word} " if "SMALL" in name else f"\\{word.capitalize()} "
    return f"\\{plain}" if plain in SPECIAL else plain


def _value(node: Element | None, name: str) -> str | None:
    """The value of a property; empty if it is there without one, null if it isn't there."""
    if node is None:
        return None
    p = node.find(name)
    return None if p is None else p.attrib.get("val", "")


def latex(node: Element) -> str:
    """LaTeX of an element whose namespaces are stripped; unknown elements give what is within."""
    part = lambda name: "" if (c := node.find(name)) is None else children(c)
    e, tag = part("e"), node.tag
    pr = node.find(f"{tag}Pr")
    if tag == "r":
        return "".join(symbol(c) for t in node.findall("t") for c in t.text or "")
    if tag == "acc":
        return f"\\{OVER_UNDER.get(_value(pr, 'chr') or '', 'hat')}{{{e}}}"
    if tag == "bar":
        return f"\\{'underline' if _value(pr, 'pos') == 'bot' else 'overline'}{{{e}}}"
    if tag == "groupChr":
        return f"\\{OVER_UNDER.get(_value(pr, 'chr') or '', 'underbrace')}{{{e}}}"
    if tag == "d":
        sides = [(_value(pr, k), usual) for k, usual in (("begChr", "("), ("endChr", ")"))]
        left, right = ("." if v == "" else "".join(f"\\{c}" if c in SPECIAL else c for c in v or usual) for v, usual in sides)
        inner = (_value(pr, "sepChr") or "|").join(children(x) for x in node.findall("e"))
        return f"\\left{left}{inner}\\right{right}"
    if tag in ("sSub", "sSup", "sSubSup"):
        return e + (f"_{{{part('sub')}}}" if "Sub" in tag else "") + (f"^{{{part('sup')}}}" if "Sup" in tag else "")
    if tag == "sPre":
        return f"{{}}_{{{part('sub')}}}^{{{part('sup')}}}{e}"
    if tag == "f":
        n, d = part("num"), part("den")
        return {"skw": f"^{{{n}}}/_{{{d}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{n}}}{{{d}}}", "lin": f"{{{n}}}/{{{d}}}"}.get(_value(pr, "type") or "bar", f"\\frac{{{n}}}{{{d}}}")
    if tag == "func":
        name = part("fName")
        return f"\\{name}({e})" if name in FUNCTIONS else f"{name}({e})" if name.startswith("\\") else f"\\operatorname{{{name}}}({e})"
    if tag == "rad":
        return f"\\sqrt[{deg}]{{{e}}}" if (deg := part("deg")) else f"\\sqrt{{{e}}}"
    if tag == "eqArr":
        return "\\begin{array}{c}" + "\\\\".join(children(x) for x in node.findall("e")) + "\\end{array}"
    if tag == "limLow":
        under = part("lim").replace("\\rightarrow", "\\to")
        return f"\\{e}_{{{under}}}" if e in LIMITS else f"\\underset{{{under}}}{{{e}}}"
    if tag == "limUpp":
        return f"\\overset{{{part('lim')}}}{{{e}}}"
    if tag == "m":
        rows = ("&".join(children(x) for x in r.findall("e")) for r in node.findall("mr"))
        return "\\begin{matrix}" + "\\\\".join(rows) + "\\end{matrix}"
    if tag == "nary":
        low, high, sign = part("sub"), part("sup"), _value(pr, "chr")
        return f"\\{OPERATORS.get(sign or '∫', 'int')}" + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + (e if low or high else f" {e}")
    return "" if tag.endswith("Pr") else children(node)


def children(node: Element) -> str:
    return "".join(map(latex, node))
