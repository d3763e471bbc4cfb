"""Root-cause analysis and corpus preparation as Spark jobs over tables."""
