"""Run plans: shifted and resized copies of a catalog analysed in one query and pooled."""
