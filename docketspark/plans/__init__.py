"""The query catalogue over the driver's tables, with its DuckDB SQL."""
