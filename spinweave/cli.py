"""Sweeps from the command line: ``python -m spinweave.cli ising out --side 16 --p "(0.1,0.3,3)" --temperature 0.5 --replicas 20``."""

from __future__ import annotations

import argparse
from fractions import Fraction
from itertools import product


#: names of kernels and their functions in plans.kernels
KERNELS = {
    "percolation": "percolation_kernel",
    "clusters": "cluster_kernel",
    "spectrum": "spectrum_kernel",
    "modes": "modes_kernel",
    "mode_ising": "mode_ising_kernel",
    "reconstruction": "reconstruction_kernel",
}


def integers(text: str) -> list[int]:
    """"16" or several separated by ";"."""
    return [int(x) for x in text.split(";")]


def number(text: str) -> float:
    """A decimal or a fraction such as 1/3."""
    return float(Fraction(text.strip()))


def values(text: str) -> list[float]:
    """"0.1", "(start,stop,count)" and several of them separated by ";"."""
    out: list[float] = []
    for part in text.split(";"):
        part = part.strip()
        if part.startswith("("):
            if not part.endswith(")") or part.count(",") != 2:
                raise argparse.ArgumentTypeError(f"not (start,stop,count): {part!r}")
            a, b, n = part[1:-1].split(",")
            start, stop, count = number(a), number(b), int(n)
            out += [start + (stop - start) * k / max(1, count - 1) for k in range(count)]
        else:
            out.append(number(part))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("kernel", choices=["ising", *KERNELS])
    p.add_argument("path", help="folder of the results' table")
    p.add_argument("--geo", default="square", help="square, triangular, hexagonal, octagonal, sc, bcc, fcc or er (side nodes)")
    p.add_argument("--side", type=integers, default=[16])
    p.add_argument("--link", type=float, default=0.1, help="er: probability of a link")
    p.add_argument("--number", type=int, default=0, help="the mode that starts a run or makes clusters")
    p.add_argument("--howmany", type=int, help="eigenvalues or modes kept")
    p.add_argument("--modes", type=int, help="modes of a reconstruction's basis")
    p.add_argument("--spins", default="uniform", help="start of a reconstruction's run: uniform, up, delta or mode_k")
    p.add_argument("--p", type=values, default=[0.1])
    p.add_argument("--temperature", type=values, default=[1.0])
    p.add_argument("--sweeps", type=int, default=5)
    p.add_argument("--replicas", type=int, default=500)
    return p


def points(a: argparse.Namespace) -> list[dict]:
    """The parameter points of a kernel: every side, p and, where it runs dynamics, temperature."""
    out = []
    for side, p in product(a.side, a.p):
        own = {"side": side, "p": p}
        if a.geo != "square":
            own["geo"] = a.geo
        if a.geo == "er":
            own["link"] = a.link
        if a.kernel in ("spectrum", "modes") and a.howmany is not None:
            own["howmany"] = a.howmany
        if a.kernel in ("clusters", "mode_ising") and a.number:
            own["number"] = a.number
        if a.kernel == "reconstruction":
            own |= {"spins": a.spins} | ({} if a.modes is None else {"modes": a.modes})
        if a.kernel in ("ising", "mode_ising", "reconstruction"):
            out += [own | {"temperature": t, "sweeps": a.sweeps} for t in a.temperature]
        else:
            out.append(own)
    return out


def main(argv: list[str] | None = None) -> int:
    """The number of replicas that were missing and have been run."""
    from pyspark.sql import SparkSession

    from .plans import kernels, sweep

    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    kernel = sweep.ising_kernel if a.kernel == "ising" else getattr(kernels, KERNELS[a.kernel])
    return sweep.run(spark, a.path, points(a), a.replicas, kernel)


if __name__ == "__main__":
    print(main())
