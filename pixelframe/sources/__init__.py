"""Sources and sinks: GeoTIFF rasters, point shapefiles, file lists, tables of results."""
