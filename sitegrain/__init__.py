"""Website and SEO analytics over tables of landed pages, as plain Spark DataFrame functions."""
