"""Removal of long byte strings that occur more than once.

Suffixes are bucketed by ``SIZE`` bytes and buckets refined by what follows and stands before, only as deep as
the length asks: the order of suffixes inside a bucket is never needed, only whether another has the same
``LENGTH`` bytes. A suffix enters by the bucket of its anchor at a later offset: the smallest hash of ``SIZE``
bytes in the window that begins with it. All windows that share an anchor move together and are taken apart
only where their buckets disagree, on levels of 137, 16 and 1 starts.

This departs from bucket-pointer refinement of a suffix array: keys of a level are digests of the bytes
themselves, made anew for what the level before left open, and not pairs of bucket identifiers of later offsets.
Identifiers would have to be kept and joined for every byte of the corpus (about 930 million rows for the
0.5 GB of the check, where the anchors are 13 million), on each of eight levels of doubling offsets.

Cases: a null text is empty; texts shorter than the length lose nothing; equal rows are each other's
repeats; strings never go over the end of a document; an empty table gives no rows. Removing bytes may cut
a character in two, so what is kept is bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.llm.common import staged
from itspark.llm.repeats import Units, without_repeats

LENGTH = 200
SIZE = 64


def shared_buckets(anchors: DataFrame) -> DataFrame:
    """Anchors whose first bytes occur at another anchor too."""
    many = staged(anchors.groupBy("core").agg(F.sum("copies").alias("n")).filter("n >= 2").select("core"), "shared")
    return anchors.join(many, "core", "left_semi")


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, size: int = SIZE, body: bool = False) -> DataFrame:
    """Every byte inside a string of ``length`` bytes that starts anywhere else too goes, all copies alike.

    ``length - size`` must be below 255.
    """
    width = length - size + 1
    return without_repeats(docs, Units(False, length, size, (width, *((16,) if width > 16 else ()), 1)), shared_buckets, body)
