"""webloom: page-evidence analytics and corpus preparation as Spark DataFrame programs."""
