"""Where matrices come from and reports go: model problems, tables, files."""
