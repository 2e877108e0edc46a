"""Link-integrity analytics on Spark: operators over tables of files, fragments, links, versions and symbols."""
