"""Model inference under tensor contracts, and model manifests."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.schema import MEMORY_REGIONS, DipError, require

ELEMENT_BYTES = {"u8": 1, "i8": 1, "f32": 4}
LAYOUTS = ("hwc", "chw")
U16, U32, I32 = (1 << 16) - 1, (1 << 32) - 1, (1 << 31) - 1


#: Fixed value: bytes of a cache line.
LINE = 32


def allocation(size: int, alignment: int, region: str) -> tuple[int, int, str]:
    """Checks a request for a buffer; memory itself is Spark's."""
    require(size > 0, "INVALID_SIZE")
    require(alignment > 0 and alignment & (alignment - 1) == 0, "INVALID_ARG")
    require(region in MEMORY_REGIONS and region != "EXTERNAL_FLASH", "INVALID_ARG", region)
    return size, alignment, region


def cache_range(address: int | None, size: int) -> tuple[int, int]:
    """Start and length of the cache lines that hold a buffer."""
    require(address is not None, "NULL_PTR")
    require(size > 0, "INVALID_SIZE")
    start, stop = address // LINE * LINE, -(-(address + size) // LINE) * LINE
    require(stop <= 1 << 64, "OVERFLOW")
    return start, stop - start


_clock = [0]


def tic() -> None:
    _clock[0] = time.perf_counter_ns()


def toc() -> int:
    """Nanoseconds since ``tic``."""
    return time.perf_counter_ns() - _clock[0]


def vendor_backend(init: Callable[[], bool], run: Callable[[bytes], bytes]) -> Callable[[bytes], bytes]:
    """An invoke function of a vendor's binding, initialised once."""
    require(init is not None and run is not None, "NULL_PTR")
    require(bool(init()), "DEVICE_ERROR")
    return run


@dataclass(frozen=True)
class Contract:
    """What a tensor must be: its size in bytes, shape, element type and layout."""

    bytes: int
    width: int
    height: int
    channels: int
    type: str = "u8"
    layout: str = "hwc"
    scale: float = 1.0
    zero_point: int = 0
    flags: frozenset = field(default_factory=frozenset)

    def validate(self) -> None:
        require(min(self.bytes, self.width, self.height, self.channels) > 0, "INVALID_SIZE")
        require(self.type in ELEMENT_BYTES and self.layout in LAYOUTS, "NOT_SUPPORTED")
        require(self.width * self.height * self.channels * ELEMENT_BYTES[self.type] == self.bytes, "INVALID_SIZE")

    def check(self, other: "Contract") -> None:
        """Raises unless ``other`` is a tensor of this contract."""
        require((other.type, other.layout) == (self.type, self.layout), "INVALID_FORMAT")
        require((other.bytes, other.width, other.height, other.channels) == (self.bytes, self.width, self.height, self.channels), "INVALID_SIZE")


class Runtime:
    """One model: ``invoke(input bytes) -> output bytes`` between two contracts. ``events`` tells what was done:
    C clean, T start of the clock, R run, t its end, I invalidate."""

    def __init__(self):
        self.backend: tuple | None = None
        self.events = ""

    def init(self, invoke: Callable[[bytes], bytes] | None, input_contract: Contract, output_contract: Contract) -> "Runtime":
        require(invoke is not None, "NULL_PTR")
        input_contract.validate()
        output_contract.validate()
        self.backend = (invoke, input_contract, output_contract)
        return self

    def infer(self, data: bytes | None, tensor: Contract, output: Contract) -> tuple[bytes, int]:
        """The output's bytes and the nanoseconds that the model took."""
        require(self.backend is not None, "NOT_INITIALIZED")
        require(data is not None, "NULL_PTR")
        invoke, wanted, result = self.backend
        wanted.check(tensor)
        result.check(output)
        require("READ_ONLY" not in output.flags, "INVALID_ARG")
        require(len(data) == tensor.bytes, "INVALID_SIZE")
        if "NPU_READ" in tensor.flags:
            self.events += "C"
        self.events += "T"
        began = time.perf_counter_ns()
        self.events += "R"
        out = invoke(data)
        took = time.perf_counter_ns() - began
        self.events += "t"
        if "NPU_WRITE" in output.flags:
            self.events += "I"
        require(len(out) == output.bytes, "INVALID_SIZE")
        return out, took

    def run(self, tensors: DataFrame) -> DataFrame:
        """Inference over (tensor_id, payload binary): a row each with payload, elapsed_ns and status; a bad tensor
        has a status and no payload, and does not stop the others. Arrow batches cross to the model."""
        require(self.backend is not None, "NOT_INITIALIZED")
        invoke, wanted, result = self.backend

        def batches(parts):
            own = Runtime().init(invoke, wanted, result)
            for part in parts:
                out = []
                for key, raw in zip(part["tensor_id"], part["payload"], strict=True):
                    try:
                        payload, took = own.infer(None if raw is None else bytes(raw), wanted, result)
                        out.append((key, payload, took, 0))
                    except DipError as e:
                        out.append((key, None, None, e.code))
                yield pd.DataFrame(out, columns=["tensor_id", "payload", "elapsed_ns", "status"]).astype({"elapsed_ns": "Int64"})

        return tensors.select("tensor_id", "payload").mapInPandas(batches, "tensor_id long, payload binary, elapsed_ns long, status int")


# --- manifests --------------------------------------------------------------------------------------------------

_TENSOR = "struct<width:bigint,height:bigint,channels:bigint,type:string,layout:string,scale:double,zero_point:bigint>"
MANIFEST = (
    "struct<model:struct<id:string,onnx_file:string,source_sha256:string>,generated:struct<artifact_sha256:string,weights_blob:string>,"
    "deployment:struct<inference_location:string,stedgeai_version:string,cube_n6_version:string>,"
    "legal:struct<license:string,label_map_id:string,dataset_license:string>,provenance:struct<training_recipe:string,quantization_recipe:string>,"
    f"io:struct<input:{_TENSOR},output:{_TENSOR}>,"
    "memory:struct<weights_bytes:bigint,activations_bytes:bigint,weights_region:string,activations_region:string>>"
)
#: The records of a manifest and their fields.
RECORDS = {
    "model": {"id": str, "onnx_file": str, "source_sha256": str},
    "generated": {"artifact_sha256": str, "weights_blob": str},
    "deployment": {"inference_location": str, "stedgeai_version": str, "cube_n6_version": str},
    "legal": {"license": str, "label_map_id": str, "dataset_license": str},
    "provenance": {"training_recipe": str, "quantization_recipe": str},
    "io": {"input": dict, "output": dict},
    "memory": {"weights_bytes": int, "activations_bytes": int, "weights_region": str, "activations_region": str},
}
TENSOR_FIELDS = {"width": int, "height": int, "channels": int, "type": str, "layout": str, "scale": float, "zero_point": int}


def _tensor_faults(t: dict, where: str) -> list[str]:
    found = [f"{where}.{k} is not a {kind.__name__}" for k, kind in TENSOR_FIELDS.items() if type(t.get(k)) is not kind]
    if found:
        return found
    sizes = [t[k] for k in ("width", "height", "channels")]
    if not all(0 < s <= U16 for s in sizes):
        found.append(f"{where}: sizes must be from 1 to {U16}")
    if t["type"] not in ELEMENT_BYTES or t["layout"] not in LAYOUTS:
        found.append(f"{where}: type or layout is not known")
    elif sizes[0] * sizes[1] * sizes[2] * ELEMENT_BYTES[t["type"]] > U32:
        found.append(f"{where}: too many bytes")
    if not -I32 - 1 <= t["zero_point"] <= I32:
        found.append(f"{where}: zero_point is out of range")
    return found


def manifest_faults(manifest: dict) -> list[str]:
    """What is wrong with a parsed manifest; nothing: it is valid. Types are strict: true is no number, 1 no float."""
    if type(manifest) is not dict or set(manifest) != set(RECORDS):
        return ["the manifest must have exactly the records " + ", ".join(RECORDS)]
    found = []
    for name, fields in RECORDS.items():
        record = manifest[name] if type(manifest[name]) is dict else {}
        for key, kind in fields.items():
            value = record.get(key)
            if type(value) is not kind:
                found.append(f"{name}.{key} is not a {kind.__name__}")
            elif kind is str and (not value or re.search(r"[\x00-\x1f]", value)):
                found.append(f"{name}.{key} is empty or has control characters")
            elif kind is dict:
                found += _tensor_faults(value, f"{name}.{key}")
    if found:
        return found
    for value in (manifest["model"]["source_sha256"], manifest["generated"]["artifact_sha256"]):
        if not re.fullmatch(r"[0-9a-fA-F]{64}", value):
            found.append("a hash must have 64 hexadecimal digits")
    memory = manifest["memory"]
    if manifest["deployment"]["inference_location"] != "mcu":
        found.append("inference_location must be mcu")
    if not all(0 < memory[k] <= U32 for k in ("weights_bytes", "activations_bytes")):
        found.append("byte counts must be positive and fit 32 bits")
    if memory["weights_region"] != "external_flash" or memory["activations_region"] not in ("fast_sram", "psram"):
        found.append("a memory region is not allowed")
    return found


def manifest_text_faults(text: str) -> list[str]:
    try:
        return manifest_faults(json.loads(text))
    except ValueError as e:
        return [f"no JSON: {e}"]


def manifest_valid(text: Column) -> Column:
    """The same rules as one native expression on JSON text (of well-typed JSON; strict types need ``manifest_faults``)."""
    m = F.from_json(text, MANIFEST, {"mode": "PERMISSIVE"})
    ok = m.isNotNull()
    keys = F.array_sort(F.json_object_keys(text))
    ok = ok & (keys == F.array(*[F.lit(k) for k in sorted(RECORDS)]))
    for name, fields in RECORDS.items():
        for key, kind in fields.items():
            value = m[name][key]
            if kind is str:
                ok = ok & value.isNotNull() & (F.length(value) > 0) & ~value.rlike(r"[\x00-\x1f]")
            elif kind is int:
                ok = ok & value.between(1, U32)
    for where in ("input", "output"):
        t = m["io"][where]
        ok = ok & t["width"].between(1, U16) & t["height"].between(1, U16) & t["channels"].between(1, U16)
        ok = ok & t["type"].isin(*ELEMENT_BYTES) & t["layout"].isin(*LAYOUTS) & t["scale"].isNotNull() & t["zero_point"].between(-I32 - 1, I32)
        ok = ok & (t["width"] * t["height"] * t["channels"] * F.when(t["type"] == "f32", 4).otherwise(1) <= U32)
    ok = ok & m["model"]["source_sha256"].rlike("^[0-9a-fA-F]{64}$") & m["generated"]["artifact_sha256"].rlike("^[0-9a-fA-F]{64}$")
    ok = ok & (m["deployment"]["inference_location"] == "mcu") & (m["memory"]["weights_region"] == "external_flash") & m["memory"]["activations_region"].isin("fast_sram", "psram")
    return F.coalesce(ok, F.lit(False))


def identifier(text: Column) -> Column:
    """A name as an identifier: other characters than letters and digits become underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")
