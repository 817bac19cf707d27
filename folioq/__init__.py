"""Knowledge-base analytics on Spark: retrieval, link graphs, hygiene and work queues."""
