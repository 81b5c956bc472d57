"""Sources and sinks."""

from fleetlens.sources.files import CSVSource, FileSource, JSONLinesSource, ParquetSource, Source, load_fixture, load_wide_channels, write_csv, write_report

__all__ = ["CSVSource", "FileSource", "JSONLinesSource", "ParquetSource", "Source", "load_fixture", "load_wide_channels", "write_csv", "write_report"]
