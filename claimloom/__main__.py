"""``python -m claimloom`` lists the queries; ``python -m claimloom NAME DATA_DIR OUT_DIR`` runs one and writes Parquet."""

import sys

from claimloom import plans


def main(args: list[str]) -> int:
    found = plans.queries()
    if len(args) != 3 or args[0] not in found:
        for name, f in found.items():
            print(f"{name}: {(f.__doc__ or '').strip().splitlines()[0]}")
        return 0 if not args else 2
    from claimloom.session import session

    found[args[0]](session(), args[1]).write.parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
