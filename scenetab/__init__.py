"""Table operators for 3D capture data on Spark: cameras, clouds, frame stacks, rays and splats."""
