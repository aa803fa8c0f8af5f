"""Table readers and the projections that turn raw tables into graph tables."""
