from curvewise.sources.tables import read_observations, read_table, write_table

__all__ = ["read_observations", "read_table", "write_table"]
