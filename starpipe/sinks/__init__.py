"""Writers: layers, CSV exports, warehouse tables, metrics and result records."""
