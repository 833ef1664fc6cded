"""Instance-space analytics on Spark.

Packages
--------
``sources``    corpus text, stage tables, file listings, exports
``functions``  feature extractors, space model, labels and selectors
``operators``  joins, upserts, geometry, nearest-neighbour search, augmentation
``plans``      the composed jobs (metadata build, space build, gap filling)
``streaming``  continuous append
``catalog``    one registered query per operator, with its SQL twin
"""
