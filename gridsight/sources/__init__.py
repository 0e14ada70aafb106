"""Reading tables, describing them and writing result tables."""
