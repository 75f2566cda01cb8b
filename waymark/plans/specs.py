"""Races, lenses and tours as URL queries: fields that don't parse fall back, one by one; writing checks them."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlencode

from waymark.sources.generators import KINDS

#: The algorithms of a race, the modes of parameters, the beats of the tour.
LANES = ("dijkstra", "bmssp", "dmsy")
MODES = ("demo", "paper")
BEATS = ("wavefront", "sorting", "pivots", "forest", "race")
#: Sizes of graphs by name; the city goes up to L.
SIZES = {"S": 500, "M": 5_000, "L": 25_000, "XL": 100_000}


@dataclass(frozen=True)
class Race:
    g: str = "sparse"
    n: int = 25_000
    seed: int = 4
    mode: str = "demo"
    race: tuple[str, ...] = ("dijkstra", "bmssp")
    target: str | int | None = None
    t: float | None = None
    bk: int | None = None
    bt: int | None = None
    dk: int | None = None
    dt: int | None = None


@dataclass(frozen=True)
class Lens:
    g: str = "sparse"
    n: int = 25_000
    seed: int = 4
    algo: str = "bmssp"
    bmssp: str = "demo"
    bk: int | None = None
    bt: int | None = None
    dmsy: str = "demo"
    dk: int | None = None
    dt: int | None = None


@dataclass(frozen=True)
class Story:
    g: str = "sparse"
    n: int = 25_000
    seed: int = 4
    step: str = "wavefront"
    t: int = 0


def roll_seed() -> int:
    """A fresh seed, not to be foretold."""
    return secrets.randbits(32)


def size_of(name: str, kind: str) -> int:
    """A named size; raises for a city beyond its largest."""
    if kind == "city" and SIZES[name] > SIZES["L"]:
        raise ValueError("a city of that size is not made")
    return SIZES[name]


def fields(query: str) -> dict[str, str]:
    """The first value of each field."""
    out: dict[str, str] = {}
    for k, v in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        out.setdefault(k, v)
    return out


def whole(text: str | None, least: float = 1) -> int | None:
    """A whole number in any usual spelling, at least `least`; None for anything else."""
    try:
        x = float(text) if text else float("nan")
    except ValueError:
        return None
    return int(x) if x == x and abs(x) != float("inf") and x == int(x) and x >= least else None


def bounded_mode(text: str | None) -> str:
    return "paper" if text == "paper" else "demo"


#: The forest-based lane's mode has the same two values.
forest_mode = bounded_mode


def block_parameter(text: str | None) -> int | None:
    """An override of k or t: a positive whole number, else none."""
    return whole(text)


def graph_fields(given: dict[str, str], least_seed: float = float("-inf")) -> dict:
    out: dict = {}
    if given.get("g") in KINDS:
        out["g"] = given["g"]
    for name, least in (("n", 1), ("seed", least_seed)):
        if (value := whole(given.get(name), least)) is not None:
            out[name] = value
    return out


def read(query: str) -> Race:
    given = fields(query)
    race = replace(Race(), **graph_fields(given, 0))
    race = replace(race, **{x: v for x in ("bk", "bt", "dk", "dt") if (v := block_parameter(given.get(x))) is not None})
    if given.get("mode") in MODES:
        race = replace(race, mode=given["mode"])
    listed = tuple(x for x in given.get("race", "").split(",") if x)
    if listed and all(x in LANES for x in listed):
        race = replace(race, race=listed)
    if given.get("target") == "none":
        race = replace(race, target="none")
    elif (at := whole(given.get("target"), 0)) is not None:
        race = replace(race, target=at)
    try:
        t = float(given.get("t", ""))
    except ValueError:
        return race
    return replace(race, t=t) if 0 <= t < float("inf") else race


def checked_graph(spec: Race | Lens | Story) -> None:
    if spec.g not in KINDS or not isinstance(spec.n, int) or spec.n < 1 or not isinstance(spec.seed, int):
        raise ValueError(f"not a graph: {spec}")


def query_of(values: dict) -> str:
    return "?" + urlencode({k: v for k, v in values.items() if v is not None}, safe=",")


def write(race: Race) -> str:
    """The query of a race; fields at their defaults are left out but for graph, size and seed."""
    checked_graph(race)
    if race.seed < 0 or not race.race or any(x not in LANES for x in race.race):
        raise ValueError(f"not a race: {race}")
    values = {"g": race.g, "n": race.n, "seed": race.seed, "mode": race.mode if race.mode != "demo" else None, "race": ",".join(race.race)}
    return query_of(values | {k: getattr(race, k) for k in ("target", "t", "bk", "bt", "dk", "dt")})


def read_lens(query: str) -> Lens:
    given = fields(query)
    blocks = {x: block_parameter(given.get(x)) for x in ("bk", "bt", "dk", "dt")}
    algo = given.get("algo") if given.get("algo") in LANES else Lens.algo
    return Lens(**{"g": Lens.g, "n": Lens.n, "seed": Lens.seed} | graph_fields(given), algo=algo, bmssp=bounded_mode(given.get("bmssp")), dmsy=forest_mode(given.get("dmsy")), **blocks)


def write_lens(lens: Lens) -> str:
    """Graph, size, seed and algorithm always; modes only where they are the paper's, overrides only where given."""
    checked_graph(lens)
    if lens.algo not in LANES or lens.bmssp not in MODES or lens.dmsy not in MODES or any(x is not None and x < 1 for x in (lens.bk, lens.bt, lens.dk, lens.dt)):
        raise ValueError(f"not a lens: {lens}")
    modes = {x: "paper" if getattr(lens, x) == "paper" else None for x in ("bmssp", "dmsy")}
    return query_of({"g": lens.g, "n": lens.n, "seed": lens.seed, "algo": lens.algo, "bmssp": modes["bmssp"], "bk": lens.bk, "bt": lens.bt, "dmsy": modes["dmsy"], "dk": lens.dk, "dt": lens.dt})


def is_story(query: str) -> bool:
    return fields(query).get("mode") == "story"


def read_story(query: str) -> Story:
    given = fields(query)
    step = given.get("step") if given.get("step") in BEATS else Story.step
    return Story(**{"g": Story.g, "n": Story.n, "seed": Story.seed} | graph_fields(given), step=step, t=whole(given.get("t"), 0) or 0)


def write_story(story: Story) -> str:
    checked_graph(story)
    if story.step not in BEATS or not isinstance(story.t, int) or story.t < 0:
        raise ValueError(f"not a tour: {story}")
    return query_of({"mode": "story", "step": story.step, "g": story.g, "n": story.n, "seed": story.seed, "t": story.t or None})


def share_url(race: Race, base: str) -> str:
    """The race's address under a page's; where the clock stood is left out."""
    return base + write(replace(race, t=None))


#: Endings of exported files.
ENDINGS = {"png": ".png", "webm": ".webm", "mp4": ".mp4"}


def export_name(race: Race, kind: str, prefix: str = "waymark") -> str:
    checked_graph(race)
    return f"{prefix}-{race.g}-{race.n}-seed-{race.seed}{ENDINGS[kind]}"


def export_caption(race: Race, url: str) -> tuple[str, str]:
    return f"seed={race.seed}", url


def can_export(all_frozen: bool, settle_all_finished: bool = False) -> bool:
    return all_frozen or settle_all_finished
