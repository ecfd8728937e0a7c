"""mosaiq: region-graph analytics over rasters, written as Spark DataFrame plans."""
