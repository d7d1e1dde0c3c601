"""weftbook: a content catalogue and garment costing engine written for Spark."""
