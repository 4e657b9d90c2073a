"""veracity.sources"""
