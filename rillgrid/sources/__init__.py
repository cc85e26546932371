"""File formats: GeoPackage, GeoTIFF, GeoJSON, XML and configuration.

Files are read as bytes by Spark (``binaryFile``) and parsed in the tasks, so any store
that Spark reads will do; writers give rows ``(name, content)``.
"""
