"""Choice of a device by a selector."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.errors import InvalidArgument, UnsupportedFormat

# The order of preference of device types.
PREFERRED = ("discrete", "integrated", "virtual", "other")


def select_device(devices: DataFrame, selector: str) -> DataFrame:
    """The one row of devices (index, name, type, uuid, vendor, device, software, compute) that a selector means: the first match.

    auto: the first device with a compute queue that is no software, by type; a number: by index; uuid:...; pci:vendor:device (hex);
    anything else: a part of the name. No match raises, and so does a match without a compute queue.
    """
    if not selector:
        raise InvalidArgument("the selector is empty")
    if selector == "auto":
        rank = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("type"))
        found = devices.where((rank > 0) & ~F.col("software") & F.col("compute")).orderBy(rank, "index").limit(1)
        if found.isEmpty():
            raise UnsupportedFormat("no device with a compute queue")
        return found
    if re.fullmatch("[0-9]+", selector):
        match = F.col("index") == int(selector)
    elif selector.startswith("uuid:"):
        match = F.lower("uuid") == "".join(c for c in selector[5:].lower() if c in "0123456789abcdef")
    elif selector.startswith("pci:"):
        pci = re.fullmatch("pci:([0-9a-fA-F]+):([0-9a-fA-F]+)", selector)
        if not pci:
            raise InvalidArgument("pci: needs two hexadecimal numbers")
        match = (F.col("vendor") == int(pci[1], 16)) & (F.col("device") == int(pci[2], 16))
    else:
        match = F.lower("name").contains(selector.lower())
    found = devices.where(match).orderBy("index").limit(1)
    row = found.first()
    if row is None:
        raise InvalidArgument(f"no device is meant by {selector}")
    if not row["compute"]:
        raise UnsupportedFormat(f"{row['name']} has no compute queue")
    return found


def satisfied(required: DataFrame, available: DataFrame) -> bool:
    """Whether every required capability is available."""
    return required.exceptAll(available.distinct()).isEmpty() if required.columns == available.columns else False
