"""Reading and writing dated tables, sample files and hand-off files."""
