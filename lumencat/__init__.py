"""lumencat: media-catalogue analytics and corpus preparation on Spark."""
