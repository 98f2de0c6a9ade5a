"""What helpers do with their arguments: small tables by helper, as dimension DataFrames and as column look-ups.

Registers r1 to r5 pass arguments. A helper may be named or given by its number."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each role, the helpers that have it and the registers of pointer and length (or of the one argument).
_PROBES = ("bpf_probe_read", "4", "bpf_probe_read_user", "112", "bpf_probe_read_kernel", "113")
_PROBE_STRINGS = ("bpf_probe_read_user_str", "114", "bpf_probe_read_kernel_str", "115")
ROLES: dict[str, tuple[tuple[tuple[str, ...], int, int | None], ...]] = {
    "probe_read_value": ((_PROBES, 1, 2),),
    "stack_output": (
        ((*_PROBES, "bpf_probe_read_str", "45", *_PROBE_STRINGS, "bpf_get_current_comm", "16", "bpf_copy_from_user", "bpf_copy_from_user_task", "bpf_dynptr_read", "bpf_snprintf"), 1, 2),
        (("bpf_d_path", "bpf_get_stack", "bpf_get_task_stack"), 2, 3),
        (("bpf_skb_load_bytes", "26", "bpf_skb_load_bytes_relative", "bpf_xdp_load_bytes"), 3, 4),
    ),
    "stack_read": ((("bpf_dynptr_slice", "bpf_dynptr_slice_rdwr"), 3, 4),),
    "writable_stack_output": ((("bpf_get_current_comm",), 1, 2),),
    "map_value_access": (((*_PROBES, *_PROBE_STRINGS), 1, 2),),
    "scalar_length": (((*_PROBES, *_PROBE_STRINGS), 2, None), (("bpf_csum_diff", "bpf_skb_load_bytes"), 4, None), (("bpf_perf_event_output",), 5, None)),
    "more_scalar_lengths": ((("bpf_csum_diff",), 2, None),),
    "dynptr_output": ((("bpf_ringbuf_reserve_dynptr", "bpf_dynptr_from_mem"), 4, None), (("bpf_dynptr_from_skb", "bpf_dynptr_from_xdp"), 3, None)),
    "dynptr_live": ((("bpf_dynptr_data", "bpf_dynptr_clone", "bpf_ringbuf_discard_dynptr", "bpf_ringbuf_submit_dynptr"), 1, None), (("bpf_dynptr_read", "bpf_dynptr_write"), 3, None)),
    "dynptr_initialized": ((("bpf_dynptr_data", "bpf_dynptr_clone", "bpf_dynptr_slice", "bpf_dynptr_slice_rdwr", "bpf_ringbuf_discard_dynptr", "bpf_ringbuf_submit_dynptr"), 1, None), (("bpf_dynptr_read", "bpf_dynptr_write"), 3, None)),
    "dynptr_data_producer": ((("bpf_dynptr_data", "bpf_dynptr_slice", "bpf_dynptr_slice_rdwr"), 1, None),),
    "dynptr_data_invalidating": ((("bpf_dynptr_write",), 1, None), (("bpf_dynptr_from_mem",), 4, None), (("bpf_dynptr_from_skb", "bpf_dynptr_from_xdp"), 3, None)),
}
# What the slots of a dynptr are made of, by the helper that initialises them.
DYNPTR_BACKING = {"bpf_dynptr_from_skb": "packet", "bpf_dynptr_from_xdp": "packet", "bpf_dynptr_from_mem": "memory"}


@dataclass(frozen=True)
class Role:
    """The registers of a role for one target column; null for helpers without it."""

    first: Column
    second: Column


def _lookup(target: Column, pairs: dict[str, int | None]) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable((k, v) for k, v in pairs.items() if v is not None)))
    return table[target]


def role(target: Column, name: str) -> Role:
    """Look-up in one of the `ROLES`, folded into the expression as a literal map."""
    rows = [(helper, a, b) for helpers, a, b in ROLES[name] for helper in helpers]
    second = {h: b for h, _, b in rows if b is not None}
    return Role(_lookup(target, {h: a for h, a, _ in rows}), _lookup(target, second) if second else F.lit(None).cast("int"))


def dimension(spark: SparkSession) -> DataFrame:
    """(role, helper, first_register, second_register): all roles as rows, under a hundred, for broadcast joins."""
    rows = [(r, h, a, b) for r, entries in ROLES.items() for helpers, a, b in entries for h in helpers]
    return spark.createDataFrame(rows, "role string, helper string, first_register int, second_register int")


def probe_read_value_pair(target: Column) -> Role:
    return role(target, "probe_read_value")


def stack_output_pair(target: Column) -> Role:
    return role(target, "stack_output")


def stack_read_pair(target: Column) -> Role:
    return role(target, "stack_read")


def writable_stack_output_pair(target: Column) -> Role:
    return role(target, "writable_stack_output")


def map_value_access_pair(target: Column) -> Role:
    return role(target, "map_value_access")


def scalar_length_register(target: Column) -> Column:
    return role(target, "scalar_length").first


def consumes_scalar_length(target: Column, register: Column) -> Column:
    """Whether a helper takes this register as a length; some take two."""
    return F.coalesce(scalar_length_register(target) == register, F.lit(False)) | F.coalesce(role(target, "more_scalar_lengths").first == register, F.lit(False))


def dynptr_output(target: Column) -> Column:
    return role(target, "dynptr_output").first


def dynptr_live(target: Column) -> Column:
    return role(target, "dynptr_live").first


def dynptr_initialized(target: Column) -> Column:
    return role(target, "dynptr_initialized").first


def dynptr_data_producer(target: Column) -> Column:
    return role(target, "dynptr_data_producer").first


def dynptr_data_invalidating(target: Column) -> Column:
    return role(target, "dynptr_data_invalidating").first


def dynptr_backing(target: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(DYNPTR_BACKING.items())))[target]
