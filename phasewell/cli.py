"""Command line: python -m phasewell.cli ROOT COMMAND ... (help lists the commands)."""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import SparkSession

from phasewell.operators.store import Store
from phasewell.schema import StoreError

COMMANDS = {
    "info": "corpora with length, count and state",
    "compare": "AMP PHASE AMP PHASE: energy of two patterns",
    "insert": "AMP PHASE [--meta k:v,...]: adds a pattern",
    "delete": "ID ...: removes patterns",
    "replace": "ID AMP PHASE [--meta k:v,...]: swaps a pattern, prints the new id",
    "query": "AMP PHASE [-k N]: best matches",
    "querydetailed": "AMP PHASE [-k N]: with phase difference, zone and zone score",
    "interference": "AMP PHASE [-k N]: the query's length and its detailed matches",
    "interferencemap": "AMP PHASE [-k N]: id, energy, phase shift and zone",
    "composite": "'AMP|PHASE; AMP|PHASE' [--weights W,...] [-k N]: matches of a superposition",
    "compositedetailed": "as composite, detailed",
    "repl": "reads commands from standard input, exit ends",
    "help": "this list",
}


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def composite(text: str) -> list[tuple[list[float], list[float]]]:
    """amp|phase; amp|phase, each a comma list."""
    return [tuple(map(numbers, part.split("|"))) for part in text.split(";") if part.strip()]


def metadata(text: str | None) -> dict[str, str]:
    return dict(x.split(":", 1) for x in (text or "").split(",") if ":" in x)


def line(m, detailed: bool) -> str:
    return "\t".join([m.id, f"{m.energy:.8f}"] + ([f"{m.phase_delta:.8f}", m.zone, f"{m.zone_score:.4f}"] if detailed else []))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phasewell", exit_on_error=False)
    p.add_argument("command", choices=[*COMMANDS])
    p.add_argument("values", nargs="*")
    for name in ("--corpus", "--weights", "--meta"):
        p.add_argument(name)
    p.add_argument("-k", type=int)
    return p


def wanted(v: list[str], n: int) -> list[str]:
    if len(v) != n:
        raise ValueError(f"{n} values expected, {len(v)} given")
    return v


def run(store: Store, args: list[str]) -> None:
    """One command; at most top_k_max rows are printed. Raises StoreError and ValueError."""
    a = parser().parse_intermixed_args(args)
    corpus, v, detailed = a.corpus or "default", a.values, a.command.endswith("detailed")
    if a.command == "help":
        print("\n".join(f"{name:18}{text}" for name, text in COMMANDS.items()))
    elif a.command == "info":
        for c in store.corpora():
            i = store.info(c)
            print(f"{c}\t{i['pattern_len']}\t{i['count']}\t{i['state']}")
    elif a.command == "compare":
        print(f"{store.compare(*map(numbers, wanted(v, 4))):.8f}")
    elif a.command == "insert":
        amplitude, phase = map(numbers, wanted(v, 2))
        print(store.insert(corpus, store._one(amplitude, phase, metadata(a.meta))))
    elif a.command == "delete":
        store.delete(corpus, v)
    elif a.command == "replace":
        print(store.replace(corpus, wanted(v, 3)[0], numbers(v[1]), numbers(v[2]), metadata(a.meta)))
    elif a.command == "interference":
        got = store.query_interference(corpus, *map(numbers, wanted(v, 2)), a.k).first()
        print(f"query\t{len(numbers(v[0]))}")
        for m in got.matches if got else ():
            print(line(m, True))
    elif a.command == "interferencemap":
        for m in store.query_interference_map(corpus, *map(numbers, wanted(v, 2)), a.k).collect():
            print(f"{m.id}\t{m.energy:.8f}\t{m.phase_shift:.8f}\t{m.zone}")
    elif a.command == "repl":
        for text in sys.stdin:
            words = shlex.split(text)
            if words[:1] == ["exit"]:
                return
            if words:
                guarded(store, words)
    else:
        if a.command.startswith("query"):
            found = store.query(corpus, *map(numbers, wanted(v, 2)), a.k, detailed=detailed)
        else:
            found = store.query_composite(corpus, composite(wanted(v, 1)[0]), numbers(a.weights or ""), a.k, detailed)
        for m in found.collect():
            print(line(m, detailed))


def guarded(store: Store, args: list[str]) -> int:
    try:
        run(store, args)
    except (StoreError, ValueError, argparse.ArgumentError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def main(args: list[str]) -> int:
    if not args or args[0] in ("help", "--help", "-h"):
        print("phasewell ROOT COMMAND ...")
        run(None, ["help"])
        return 0 if args else 1
    if len(args) < 2:
        print("error: a command is missing, see help", file=sys.stderr)
        return 1
    return guarded(Store(SparkSession.builder.appName("phasewell").getOrCreate(), args[0]), args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
