"""Log tables, pointer tables, publishing and documents."""
