"""Roofline arithmetic with several memories, and the peaks of devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.columns import giga_to_gibi, memory_sum, pico_to, safe_divide

# fixed values: codes of memory spaces and operations, and device capabilities
HBM, CMEM, VMEM = 1, 2, 3
READ, WRITE = 1, 2
MEMORIES = {"hbm": (None, HBM), "cmem_read": (READ, CMEM), "cmem_write": (WRITE, CMEM), "vmem_read": (READ, VMEM), "vmem_write": (WRITE, VMEM)}
LABELS = {"hbm": "HBM", "cmem_read": "CMEM Read", "cmem_write": "CMEM Write", "vmem_read": "VMEM Read", "vmem_write": "VMEM Write"}
#: compute capability * 1000 -> best FLOP per core and clock
CUDA_PEAK = {
    2000: 64.0, 3000: 384.0, 5000: 256.0, 6000: 256.0, 6010: 256.0, 7000: 1024.0, 7050: 1024.0, 8000: 2048.0, 8060: 1024.0, 8090: 1024.0,
    9000: 4096.0, 10000: 8192.0,
}
#: architecture -> (best FLOP per core and clock, shared-memory bytes per core and clock)
ROCM_PEAK = {"gfx908": (1024.0, 128.0), "gfx90a": (1024.0, 128.0), "gfx942": (2048.0, 128.0), "gfx950": (4096.0, 256.0)}


def _number(props: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(props, F.lit(name)).try_cast("double"), F.lit(0.0))


def device_peaks(planes: DataFrame) -> DataFrame:
    """planes(plane_id, props map) -> (plane_id, peak_gflops, hbm_gbps, shared_gbps,
    ridge_point): from the device's own stats, else from the capability table at the greatest
    capability not above its own."""
    p = F.col("props")
    clock, cores = _number(p, "clock_rate") / 1e6, _number(p, "core_count")
    major, minor = _number(p, "compute_cap_major"), _number(p, "compute_cap_minor")
    wanted = major * 1000 + minor * 10
    per_core = F.lit(CUDA_PEAK[min(CUDA_PEAK)])
    for key in sorted(CUDA_PEAK):
        per_core = F.when(wanted >= key, F.lit(CUDA_PEAK[key])).otherwise(per_core)
    shared = F.when(major <= 2, 64.0).otherwise(256.0)
    vendor, arch = F.try_element_at(p, F.lit("device_vendor")), F.try_element_at(p, F.lit("gpu_device_name"))
    amd_flops, amd_shared = F.lit(0.0), F.lit(0.0)
    for name, (flops, lds) in ROCM_PEAK.items():
        amd_flops, amd_shared = F.when(arch == name, flops).otherwise(amd_flops), F.when(arch == name, lds).otherwise(amd_shared)
    table = F.when(vendor == "Nvidia", per_core).when(vendor == "AMD", amd_flops).otherwise(0.0)
    lds = F.when(vendor == "Nvidia", shared).when(vendor == "AMD", amd_shared).otherwise(0.0)
    own = _number(p, "peak_teraflops_per_second") * 1e3
    gflops = F.when(own > 0, own).otherwise(cores * table * clock)
    hbm = _number(p, "memory_bandwidth") / 1e9
    return planes.select("plane_id", gflops.alias("peak_gflops"), hbm.alias("hbm_gbps"), (cores * lds * clock).alias("shared_gbps"), safe_divide(gflops, hbm).alias("ridge_point"))


def roofline_columns(df: DataFrame, peaks: dict[str, float], tpu: bool = True) -> DataFrame:
    """Op metrics (time, flops, model_flops?, bytes, memory?) with their rates in GFLOP/s
    and GiB/s per memory, intensities, utilization, and what bounds them. peaks holds gflops
    and the bandwidth in GB/s of the memories (hbm, cmem_read, ..., shared)."""
    ns = pico_to("ns", F.col("time"))
    memory = F.col("memory") if "memory" in df.columns else F.array().cast("array<struct<op:int,space:bigint,bytes:bigint>>")
    bare = F.size(memory) == 0
    used = {m: memory_sum(memory, op, space) for m, (op, space) in MEMORIES.items()}
    used["hbm"] = F.when(bare, F.col("bytes")).otherwise(used["hbm"])
    model = F.col("model_flops") if "model_flops" in df.columns else F.col("flops")
    df = df.withColumns({
        "measured_flop_rate": safe_divide(F.col("flops"), ns), "model_flop_rate": safe_divide(model, ns),
        "measured_memory_bw": giga_to_gibi(safe_divide(F.col("bytes"), ns)), "operational_intensity": safe_divide(F.col("flops"), F.col("bytes")),
        **{f"{m}_bytes": b for m, b in used.items()},
    })
    df = df.withColumns({f"{m}_bw": giga_to_gibi(safe_divide(F.col(f"{m}_bytes"), ns)) for m in MEMORIES})
    df = df.withColumns({f"{m}_operational_intensity": safe_divide(F.col("flops"), F.col(f"{m}_bytes")) for m in MEMORIES})
    gibi = {m: peaks.get(m, 0.0) * 1e9 / 2**30 for m in (*MEMORIES, "shared")}

    def use(m, bw):
        return safe_divide(F.col(bw), F.lit(gibi[m]))

    compute = safe_divide(F.col("measured_flop_rate"), F.lit(peaks["gflops"]))
    # candidates in order; a later one wins only if it is strictly larger
    bound = F.struct(compute.alias("u"), F.when(compute > 0, "Compute").otherwise("Unknown").alias("name"), F.when(compute > 0, F.col("operational_intensity")).otherwise(F.lit(0.0)).alias("oi"))
    for m in MEMORIES:
        if m == "hbm" or (tpu and gibi[m]):
            u = F.when(F.lit(m == "hbm") | (F.col(f"{m}_bytes") != 0), use(m, f"{m}_bw")).otherwise(F.lit(0.0))
            bound = F.when(u > bound["u"], F.struct(u.alias("u"), F.lit(LABELS[m]).alias("name"), F.col(f"{m}_operational_intensity").alias("oi"))).otherwise(bound)
    if not tpu and gibi["shared"]:
        u = use("shared", "hbm_bw")
        bound = F.when(u > bound["u"], F.struct(u.alias("u"), F.lit("Shm/L1").alias("name"), F.col("hbm_operational_intensity").alias("oi"))).otherwise(bound)
    df = df.withColumn("_bound", bound)
    top = F.greatest(*(use(m, f"{m}_bw") for m in MEMORIES))
    df = df.withColumns({"bound_by": F.col("_bound.name"), "bottleneck_operational_intensity": F.col("_bound.oi"), "compute_efficiency": compute, "max_mem_bw_utilization": top})
    df = df.withColumn("roofline_efficiency", F.greatest("compute_efficiency", "max_mem_bw_utilization"))
    return df.withColumn("optimal_flop_rate", safe_divide(F.col("measured_flop_rate"), F.col("roofline_efficiency"))).drop("_bound", *(f"{m}_bytes" for m in MEMORIES))
