"""python -m chanspark FILE [-w OUT] [-z] [-p FOLDER] [--parquet_compression C] [-m OUT] [--hdf5_compression C] [-i]"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chanspark", description="Measurement files: summary, copy as MDF 4.2, export.")
    p.add_argument("file")
    p.add_argument("-w", "--write", help="write the file again as MDF 4.2")
    p.add_argument("-z", "--compress", action="store_true", help="compress what -w writes")
    p.add_argument("-p", "--export_to_parquet", help="folder for Parquet data sets")
    p.add_argument("--parquet_compression", default=None)
    p.add_argument("-m", "--export_to_hdf5", help="HDF5 file")
    p.add_argument("--hdf5_compression", default=None)
    p.add_argument("-i", "--info", action="store_true", help="print a summary")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .mdf import MdfFile

    file = MdfFile(SparkSession.builder.appName("chanspark").getOrCreate(), a.file)
    if a.write:
        file.write(a.write, a.compress)
    if a.export_to_parquet:
        file.export_parquet(a.export_to_parquet, a.parquet_compression)
    if a.export_to_hdf5:
        file.export_hdf5(a.export_to_hdf5, a.hdf5_compression)
    if a.info:
        file.header().show(truncate=False)
        file.describe().show(1000, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
