"""SBML models of the five rate laws, read whole and refused by name where they hold anything else."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

from labspark.kernels.network import Network, Reaction

REFUSED = ("listOfEvents", "listOfRules", "listOfConstraints", "listOfFunctionDefinitions", "listOfInitialAssignments")


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for c in e if _name(c) == name for x in c]


def _factors(math: ET.Element) -> tuple[str, list]:
    """The operator and arguments of an application, names and numbers as leaves."""
    if _name(math) in ("ci", "cn"):
        return ("leaf", [(math.text or "").strip()])
    children = list(math)
    return _name(children[0]), [_factors(c) for c in children[1:]]


def _leaves(node: tuple[str, list]) -> list[str] | None:
    """Names of a product; None for anything else. Powers repeat their base."""
    kind, args = node
    if kind == "leaf":
        return args
    if kind == "times":
        parts = [_leaves(a) for a in args]
        return None if any(p is None for p in parts) else [n for p in parts for n in p]
    if kind == "power" and args[0][0] == "leaf" and args[1][0] == "leaf" and args[1][1][0].isdigit():
        return args[0][1] * int(args[1][1][0])
    return None


def read_sbml(text: str) -> Network:
    """The network of a document; raises ValueError with the construct's name where it is not supported."""
    root = ET.fromstring(text)
    model = next((c for c in root if _name(c) == "model"), None)
    if model is None:
        raise ValueError("no model")
    for c in model:
        if _name(c) in REFUSED and len(c):
            raise ValueError(f"{_name(c)} is not supported")
    sizes = {c.get("id"): float(c.get("size", 1)) for c in _find(model, "listOfCompartments")}
    species, boundary = {}, set()
    for s in _find(model, "listOfSpecies"):
        amount = s.get("initialAmount")
        species[s.get("id")] = float(amount) if amount is not None else float(s.get("initialConcentration", 0)) * sizes.get(s.get("compartment"), 1.0)
        if "true" in (s.get("boundaryCondition"), s.get("constant")):
            boundary.add(s.get("id"))
    values = {p.get("id"): float(p.get("value", "nan")) for p in _find(model, "listOfParameters")}
    reactions = []
    for r in _find(model, "listOfReactions"):
        side = lambda name: {x.get("species"): float(x.get("stoichiometry", 1)) for x in _find(r, name)}  # noqa: B023, E731
        law = next((c for c in r if _name(c) == "kineticLaw"), None)
        if law is None:
            raise ValueError(f"reaction {r.get('id')!r} has no kineticLaw")
        own = values | {p.get("id"): float(p.get("value", "nan")) for k in ("listOfParameters", "listOfLocalParameters") for p in _find(law, k)}
        body = _factors(next(c for c in law if _name(c) == "math")[0])
        reactants, products = side("listOfReactants"), side("listOfProducts")
        kind, params = _classify(r.get("id"), body, reactants, products, own, set(sizes))
        reactions.append(Reaction(r.get("id"), reactants, products, kind, params))
    return Network(species, reactions, frozenset(boundary))


def _mass_action(body, side: dict[str, float], values: dict[str, float], places: set[str]) -> str | None:
    """The constant of a product of one constant and exactly the side's species."""
    names = _leaves(body)
    if names is None:
        return None
    names = [n for n in names if n not in places]
    constants = [n for n in names if n in values]
    wanted = sorted(s for s, n in side.items() for _ in range(int(n)))
    return constants[0] if len(constants) == 1 and sorted(n for n in names if n not in values) == wanted else None


def _classify(name, body, reactants, products, values, places) -> tuple[str, dict[str, float]]:
    if (k := _mass_action(body, reactants, values, places)) is not None:
        return ("mass_action" if reactants else "constant"), {"k": values[k]}
    kind, args = body
    if kind == "times":  # a compartment before the law itself
        inner = [a for a in args if not (a[0] == "leaf" and a[1][0] in places)]
        if len(inner) == 1:
            return _classify(name, inner[0], reactants, products, values, places)
    if kind == "minus" and len(args) == 2:
        there, back = _mass_action(args[0], reactants, values, places), _mass_action(args[1], products, values, places)
        if there and back:
            return "reversible", {"k": values[there], "k_back": values[back]}
    if kind == "divide" and args[1][0] == "plus" and len(args[1][1]) == 2 and (top := _leaves(args[0])):
        s = next(iter(reactants), None)
        vmax = [n for n in top if n in values]
        low = [_leaves(a) for a in args[1][1]]
        if s in top and len(vmax) == 1 and [s] in low:
            km = next((x[0] for x in low if x and x != [s] and x[0] in values), None)
            if km:
                return "michaelis_menten", {"vmax": values[vmax[0]], "km": values[km]}
    raise ValueError(f"the rate law of reaction {name!r} is not supported")


def write_sbml(net: Network, name: str = "model") -> str:
    """A document that read_sbml takes back to the same network; Hill laws have no form here and are refused."""
    ci = lambda x: f"<ci>{x}</ci>"
    times = lambda xs: f"<apply><times/>{''.join(map(ci, xs))}</apply>"
    out = [f'<?xml version="1.0" encoding="UTF-8"?><sbml xmlns="http://www.sbml.org/sbml/level3/version2/core" level="3" version="2"><model id={quoteattr(name)}><listOfCompartments><compartment id="c" size="1" constant="true"/></listOfCompartments><listOfSpecies>']
    for s, v in zip(net.names, net.start, strict=True):
        out.append(f'<species id={quoteattr(s)} compartment="c" initialAmount="{float(v)!r}" boundaryCondition="{str(s in net.boundary).lower()}"/>')
    out.append("</listOfSpecies><listOfReactions>")
    for r in net.reactions:
        names = {k: f"{r.name}_{k}" for k in r.params}
        side = lambda d: [s for s, n in d.items() for _ in range(int(n))]
        if r.law in ("mass_action", "constant"):
            body = times([names["k"], *side(r.reactants)])
        elif r.law == "reversible":
            body = f"<apply><minus/>{times([names['k'], *side(r.reactants)])}{times([names['k_back'], *side(r.products)])}</apply>"
        elif r.law == "michaelis_menten":
            s = next(iter(r.reactants))
            body = f"<apply><divide/>{times([names['vmax'], s])}<apply><plus/>{ci(names['km'])}{ci(s)}</apply></apply>"
        else:
            raise ValueError(f"{r.law} has no written form")
        refs = lambda d: "".join(f'<speciesReference species={quoteattr(s)} stoichiometry="{n:g}"/>' for s, n in d.items())
        params = "".join(f'<localParameter id={quoteattr(names[k])} value="{float(v)!r}"/>' for k, v in r.params.items())
        out.append(
            f"<reaction id={quoteattr(r.name)}><listOfReactants>{refs(r.reactants)}</listOfReactants><listOfProducts>{refs(r.products)}</listOfProducts>"
            f'<kineticLaw><math xmlns="http://www.w3.org/1998/Math/MathML">{body}</math><listOfLocalParameters>{params}</listOfLocalParameters></kineticLaw></reaction>'
        )
    return "".join(out) + "</listOfReactions></model></sbml>"
