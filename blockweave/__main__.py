"""python -m blockweave compress FOLDER FILE [-q QUALITY] [--no-ycbcr] | decompress FILE FOLDER | manifest FOLDER"""

from __future__ import annotations

import argparse
import sys

from .plans import codec
from .session import session
from .sources import container, images


def quality(text: str) -> int:
    """A whole number from 1 to 100."""
    try:
        codec.check_options(int(text))
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"quality must be a whole number from 1 to 100, not {text!r}") from e
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockweave")
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("compress", help="a folder of images to one container")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("-q", "--quality", type=quality, default=50)
    c.add_argument("--no-ycbcr", dest="ycbcr", action="store_false")
    c.add_argument("--mode", choices=("window", "exact"), default="window")
    c.add_argument("--order", choices=("path", "numeric"), default="path")
    d = sub.add_parser("decompress", help="a container to PNG files")
    d.add_argument("source")
    d.add_argument("target")
    m = sub.add_parser("manifest", help="a folder's images in numeric order")
    m.add_argument("source")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    try:
        if a.verb == "compress":
            codec.compress(spark, a.source, a.target, a.quality, a.ycbcr, a.mode, a.order)
        elif a.verb == "decompress":
            codec.decompress(spark, a.source, a.target)
        else:
            for r in images.manifest(images.list_files(spark, a.source)).orderBy("frame_idx").toLocalIterator():
                print(r.frame_idx, r.path)
    except (container.ContainerError, images.ImageError, ValueError, OSError) as e:
        print(f"blockweave: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
